"""Euclidean distance as an expression, so that plans stay inside code generation and top-k stays a top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def l2(a: Column, b: Column | Sequence[float]) -> Column:
    """Distance of two vectors; null if one is null; an error if their sizes differ."""
    a, b = a.cast(DOUBLES), (b if isinstance(b, Column) else literal(b)).cast(DOUBLES)
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    wrong = F.raise_error(F.concat(F.lit("vector distance dimension mismatch: "), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string"))).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), wrong).otherwise(total)


def l2_sql(a: str, b: str) -> str:
    """The same as SQL text."""
    a, b = f"CAST(({a}) AS ARRAY<DOUBLE>)", f"CAST(({b}) AS ARRAY<DOUBLE>)"
    wrong = f"CAST(raise_error(concat('vector distance dimension mismatch: ', size({a}), ' vs ', size({b}))) AS DOUBLE)"
    total = f"sqrt(aggregate(zip_with({a}, {b}, (vx, vy) -> (vx - vy) * (vx - vy)), 0D, (vs, ve) -> vs + ve))"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(NULL AS DOUBLE) WHEN size({a}) <> size({b}) THEN {wrong} ELSE {total} END)"
