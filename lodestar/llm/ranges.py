"""Ranges of a number given by cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def range_of(k: Column, cuts: list[int]) -> Column:
    """The number of cuts below ``k``, found by groups of cuts first."""
    if not cuts:
        return F.lit(0)
    size = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < k))
    coarse = below(longs([g[-1] for g in groups[:-1]])) if len(groups) > 1 else F.lit(0)
    return let(coarse, lambda g: g * size + below(F.element_at(F.array(*[longs(x) for x in groups]), g + 1)))
