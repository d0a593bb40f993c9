"""Helpers shared by the corpus operators: shared storage, bounded Arrow batches, numbering without one big task."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most, so that a Python worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: The folder that this package is imported from.
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The tables written inside each open scratch(), innermost last.
_open: list[list[str]] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end: for results that have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As materialize(), kept beyond the innermost scratch()."""
    inner = _open.pop() if _open else None
    try:
        return materialize(df, name)
    finally:
        if inner is not None:
            _open.append(inner)


def bounded_batches(spark: SparkSession) -> None:
    """Limit what one Arrow batch carries to a Python worker, in rows and in bytes; let workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """A table of literals; its size is known to the planner. columns: (name, type)."""
    cells = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, columns)]) for r in rows]
    empty = F.array().cast(f"array<struct<{', '.join(f'`{c}`: {t}' for c, t in columns)}>>")
    return spark.range(1).select(F.inline(F.array(*cells) if cells else empty))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def number_within(df: DataFrame, group: list[str], order: list[Column], spread: Column, per_chunk: int, out: str) -> DataFrame:
    """Gapless numbers from 0 inside each group, without putting a whole group into one task.

    Rows are dealt to chunks by a hash of `spread`; each chunk is numbered by itself and shifted by the
    counts of the chunks before it. Chunks have about `per_chunk` rows of the whole table. `df` must be cheap
    and stable to read twice (a written table).
    """
    chunks = max(1, df.count() // per_chunk + 1)
    dealt = df.withColumn("_chunk", F.pmod(spread, F.lit(chunks)).cast("int"))
    counts = dealt.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_chunk").alias("_g_chunk"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(*group, "_chunk").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(own) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group] + [F.col("_chunk") == F.col("_g_chunk")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return numbered.join(shifts, cond).withColumn(out, (F.col("_row") + F.col("_shift")).cast("long")).select(*df.columns, out)
