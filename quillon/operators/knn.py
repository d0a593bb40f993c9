"""Nearest neighbours: exact top-k by Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vector import l2


def nearest(df: DataFrame, vector: str, query: Sequence[float] | Column, k: int, tie: str | None = None, out: str = "distance") -> DataFrame:
    """The k rows nearest to `query`, nearest first, null distances last; ties by the column `tie`.

    One pass with a heap of k rows in each task (TakeOrderedAndProject): no shuffle of the table.
    """
    order = [F.col(out).asc_nulls_last(), *([F.col(tie)] if tie else [])]
    return df.withColumn(out, l2(F.col(vector), query)).orderBy(*order).limit(k)


def within(df: DataFrame, vector: str, query: Sequence[float] | Column, radius: float, out: str = "distance") -> DataFrame:
    """Rows nearer than `radius`."""
    return df.withColumn(out, l2(F.col(vector), query)).filter(F.col(out) < radius)
