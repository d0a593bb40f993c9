"""Rows for INSERT, UPDATE and DELETE as DataFrames, and the constraints they must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.sources.store import TableMeta


def coerced(x: str, kind: str, text_literal: bool = False) -> str:
    """SQL for a value stored in a column: numbers from anything (0 if unreadable), text from anything; null stays null."""
    if kind in ("int", "bigint"):
        return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast(({x}) AS BIGINT), CAST(try_cast(({x}) AS DOUBLE) AS BIGINT), 0) END)"
    if kind == "real":
        return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast(({x}) AS DOUBLE), 0D) END)"
    if kind == "boolean":
        return f"(lower(CAST(({x}) AS STRING)) IN ('true', '1'))"
    if kind == "vector":
        return f"coalesce(from_json({x}, 'array<double>'), CAST(raise_error('cannot read a VECTOR from text') AS ARRAY<DOUBLE>))" if text_literal else f"CAST(({x}) AS ARRAY<DOUBLE>)"
    return f"CAST(({x}) AS STRING)"


def check_not_null(rows: DataFrame, table: TableMeta) -> None:
    needed = [c.name for c in table.columns if c.not_null or c.name in table.primary_key]
    if needed:
        bad = rows.select(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in needed]).first()
        for c in needed:
            if bad[c]:
                raise EngineError(f"NOT NULL constraint failed: {c}")


#: New rows up to which their keys are broadcast to the scan of the old ones.
BROADCAST_ROWS = 100_000


def clashes(full: DataFrame, before: DataFrame, key: list[str], rows: int) -> DataFrame:
    """Rows of `before` that have a key of `full`: a scan without a shuffle where `full` has few rows, with the keys' range pushed down."""
    for c in key:
        low, high = full.agg(F.min(f"`{c}`"), F.max(f"`{c}`")).first()
        if low is not None:
            before = before.filter((F.col(f"`{c}`") >= F.lit(low)) & (F.col(f"`{c}`") <= F.lit(high)))
    return before.join(F.broadcast(full) if rows <= BROADCAST_ROWS else full, key, "left_semi")


def check_unique(rows: DataFrame, table: TableMeta, before: DataFrame | None = None, n: int | None = None) -> None:
    """No two rows with equal keys in `rows` (`n` of them), nor a row of `before` with a key of `rows`; keys with a null are free."""
    for key in [k for k in [table.primary_key, *table.uniques] if k]:
        columns = [F.col(f"`{c}`") for c in key]
        full = rows.select(*columns).dropna()
        found = full.groupBy(*columns).count().filter("count > 1").select(*columns).limit(1).collect()
        if not found and before is not None:
            found = clashes(full, before.select(*columns), key, rows.count() if n is None else n).limit(1).collect()
        if found:
            raise EngineError(f"UNIQUE constraint failed: {', '.join(key)} = {', '.join(str(v) for v in found[0])}")


def numbered(rows: DataFrame, column: str, first: int) -> tuple[DataFrame, int]:
    """Nulls of `column` filled with numbers from `first` on, in the order of the written rows; and how many there were.

    `rows` must be a written table: numbers follow file and row position, so no task has to see all rows.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).filter(F.col(f"`{column}`").isNull())
    counts = at.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).orderBy("_file").collect()  # a row a file
    total = sum(r["n"] for r in counts)
    starts, n = {}, first
    for r in counts:
        starts[r["_file"]] = n
        n += r["n"]
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else None
    if offset is None:
        return rows, 0
    from pyspark.sql import Window

    own = Window.partitionBy("_file").orderBy("_row")
    new = at.withColumn(column, (F.row_number().over(own) - 1 + offset[F.col("_file")]).cast("long")).drop("_file", "_row")
    return rows.filter(F.col(f"`{column}`").isNotNull()).unionByName(new), total
