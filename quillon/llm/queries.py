"""The queries of this subpackage: each operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, linededup, neardup, packing, quality, secrets, sharding, spotsigs, warc
from quillon.llm.common import documents, materialize

#: Risk of quality_loose.
LOOSE = {"alpha": 0.25, "delta": 0.2}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    fixed = F.filter("spans", lambda s: s["kind"] != "named")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(fixed).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(documents(spark, sf_dir), report="cut_lines").select("doc_id", "text", "n_chars", "cut_lines")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = materialize(warc.archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc", **warc.STORED)
    return warc.records(images, payloads=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_verdicts(spark: SparkSession, sf_dir: str, **risk: float) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = materialize(quality.figures(docs.select("doc_id", "text", "lang")).drop("text"), "figures")
    rows = quality.judged(measured, quality.rules(measured, labels, **risk))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark, sf_dir)


def quality_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4, with a risk that small holdouts can certify in several strata."""
    return quality_verdicts(spark, sf_dir, **LOOSE)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.transcode(documents(spark, sf_dir), TOKENIZER)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spotsigs.beside_next(documents(spark, sf_dir)).withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    near = spotsigs.fingerprints(near.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sets", "next_sets"), "edited", "edited_sets")
    return near.select("doc_id", "n_chars", "edited_sha256", spotsigs.shown(F.col("sets")).alias("fingerprint"), spotsigs.shown(F.col("edited_sets")).alias("edited_fingerprint"), spotsigs.likeness(F.col("sets"), F.col("edited_sets")).alias("near_edited"), spotsigs.likeness(F.col("sets"), F.col("next_sets")).alias("near_next"))


def spotsigs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near classes of the fingerprints of op8."""
    return spotsigs.near_classes(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out("id"))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secrets, op2_line_dedup, op3_warc, op4_quality, op5_near_dup, op6_bpe, op7_sharding, op8_spotsigs, op9_packing, op10_langid, pipeline, quality_loose, spotsigs_near]
    return {f.__name__: f for f in own}


#: Base 32 of SHA-1 from its bits; the largest page of equal payloads is the response.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM m
"""


def quality_sql(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    """The base figures, and the tests of the cutoffs one after the other, in DuckDB SQL."""
    grid, order = quality.GRID, quality.steps(quality.GRID)
    names = list(grid)
    rate = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_words"), "repeat_rate": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words")}
    rates = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS {f}" for f, (a, b) in rate.items())
    over = ", ".join(f"len(list_filter({[*cutoffs]!r}::DOUBLE[], lambda c: {f} > c)) AS p{i}" for i, (f, cutoffs) in enumerate(grid.items()))
    cells = ", ".join(f"p{i}" for i in range(len(grid)))
    least = math.ceil(math.log(delta / 2) / math.log1p(-alpha))
    tests = ", ".join(f"({t}, {names.index(f)}, {j})" for t, (f, j) in enumerate(order, 1))
    level = [f"{x!r}::DOUBLE / strata" for x in quality.levels(grid, delta, 1)]
    trial = ", ".join(f"CASE WHEN figure = {i} THEN j ELSE a{i} END AS b{i}" for i in range(len(grid)))
    wrong = " OR ".join(f"c.p{i} > b{i}" for i in range(len(grid)))
    kept = " AND ".join(f"coalesce(m.{f} <= ({[*c]!r}::DOUBLE[])[ok.a{i} + 1], true)" for i, (f, c) in enumerate(grid.items()))
    after = ", ".join(f"CASE WHEN passed THEN b{i} ELSE a{i} END" for i in range(len(grid)))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY rid),
f AS (SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {rates} FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0),
h AS (SELECT lang, {over} FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
s AS (SELECT lang, list({{{", ".join(f"'p{i}': p{i}" for i in range(len(grid)))}, 'n': n}}) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, {cells}, count(*) AS n FROM h GROUP BY ALL) GROUP BY lang HAVING sum(n) >= {least}),
z AS (SELECT s.*, (SELECT count(*) FROM s) AS strata FROM s),
t(step, figure, j) AS (VALUES {tests}),
q AS (
  SELECT lang, cells, n, strata, 0 AS step, {", ".join(f"{len(c)} AS a{i}" for i, c in enumerate(grid.values()))}, []::INTEGER[] AS failed FROM z
  UNION ALL
  SELECT lang, cells, n, strata, step, {after}, CASE WHEN passed OR skipped THEN failed ELSE list_append(failed, figure) END
  FROM (SELECT *, NOT skipped AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}::DOUBLE) + (n - i) * ln(1 - {alpha!r}::DOUBLE)))) <= CASE len(failed) {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(level))} ELSE 0 END AND k < n AS passed
    FROM (SELECT *, list_contains(failed, figure) AS skipped, CAST(coalesce(list_sum(list_transform(list_filter(cells, lambda c: {wrong}), lambda c: c.n)), 0) AS BIGINT) AS k
      FROM (SELECT q.lang, cells, n, strata, t.step, {", ".join(f"a{i}" for i in range(len(grid)))}, failed, figure, {trial} FROM q JOIN t ON t.step = q.step + 1)))
),
ok AS (SELECT * FROM q WHERE step = {len(order)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept
FROM m LEFT JOIN ok ON ok.lang IS NOT DISTINCT FROM m.lang
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_quality": quality_sql(), "quality_loose": quality_sql(**LOOSE)}
