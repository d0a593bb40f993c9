"""Scalar functions as columns, where the dialect's meaning differs from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity: -2.5 becomes -2."""
    scale = F.pow(F.lit(10.0), F.lit(digits))
    return F.floor(x * scale + 0.5) / scale
