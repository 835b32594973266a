"""Column expressions over numeric vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def gap(low: Column, high: Column, q: Column) -> Column:
    """How far ``q`` lies outside [low, high]."""
    return F.when(q.between(low, high), F.lit(0)).otherwise(F.least(F.abs(high - q), F.abs(low - q)))
