"""Corpus pipeline: language ID, line dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of `documents`;
the last returns packed pieces. run() writes every stage as Parquet in the shared folder and reads it again.

- language_id: learns from the stage's own labelled rows and drops documents without a letter (`und`) and those whose
  language it can't tell (score below LEAST_CHANCE times what chance gives). Where no row to learn from has a label, only those without a
  letter go.
- line_dedup: cuts blocks of lines that an earlier document has; a document that is a copy as a whole becomes empty.
- near_dup: keeps the text of the least doc_id in each class of near-equal texts, the empty texts being one class.
- secret_scan: replaces secrets by a mark.
- packing: pieces of at most 1024 tokens in sequences.

Null texts: dropped by language_id; later stages take them as empty. Rows that repeat an id are judged by
their texts in near_dup, and kept or dropped together where those are equal. Extra columns pass through to the last stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, linededup, neardup, packing, secrets
from quillon.llm.common import documents, fresh, scratch, written
from quillon.llm.queries import TOKENIZER

#: With L languages chance scores 1 / L; a document in any of them scores clearly more.
LEAST_CHANCE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, ~langid.held_out("id"))
    return langid.known(docs, model, min(1.0, LEAST_CHANCE / len(model.languages)) if model else 0.0)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name, text = fresh(docs, "_gone"), fresh(docs, "_gone_text")
    gone = neardup.spare(docs).select(F.col("doc_id").alias(name), F.col("h").alias(text))
    return docs.join(gone, (F.col("doc_id") == F.col(name)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text)), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dup", near_dup), ("secret_scan", secret_scan), ("packing", pack)]

#: Training, alignment, sampling and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage wrote on its way isn't needed once its rows are written
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
