"""A KD tree over vectors: splits fitted on a bounded sample, leaves as a column, boxes that prune.

A node is cut on the dimension in which its rows spread widest, at their median; a row goes left if its value is at most
the split's. Nodes are numbered as in a heap: the root is 1, a node's children are 2 n and 2 n + 1. They number 2^(levels + 1)
at most, which bounds what is collected and broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import gap
from lodestar.storage import local

#: Most levels of a tree (4096 leaves), and rows at most or so from which one round's splits are fitted.
LEVELS, SAMPLE = 12, 50_000


def fit(points: dict[int, np.ndarray], sizes: dict[int, float], leaf_rows: int, levels: int = LEVELS) -> list[tuple[int, int, float]]:
    """(node, dim, split) below the nodes of ``points``, samples of their ``sizes`` rows, down to leaves of ``leaf_rows`` rows or so."""
    made, todo = [], [(node, x, float(sizes[node])) for node, x in sorted(points.items())]
    while todo:
        node, x, n = todo.pop()
        if n <= leaf_rows or node.bit_length() > levels or len(x) < 2:
            continue
        dim = int(np.ptp(x, axis=0).argmax())
        values = np.sort(x[:, dim])
        if values[0] == values[-1]:
            continue
        split = values[(len(values) - 1) // 2]
        if split == values[-1]:
            split = values[values < split][-1]
        left = x[:, dim] <= split
        made.append((node, dim, float(split)))
        todo += [(2 * node, x[left], n * left.mean()), (2 * node + 1, x[~left], n * (1 - left.mean()))]
    return made


def descend(vectors: DataFrame, splits: list[tuple[int, int, float]], column: str = "embedding") -> DataFrame:
    """``vectors`` with leaf: where each row's way down ends, from the root or from the leaf that it has already."""
    out = vectors if "leaf" in vectors.columns else vectors.withColumn("leaf", F.lit(1).cast("long"))
    if not splits:
        return out
    names = {node for node, _, _ in splits}
    depth = 1 + max(_above(node, names) for node in names)
    table = local(vectors.sparkSession, splits, "leaf long, _dim int, _split double")
    for _ in range(depth):
        value = F.element_at(F.col(column), F.col("_dim") + 1).cast("double")
        below = 2 * F.col("leaf") + F.when(value <= F.col("_split"), 0).otherwise(1)
        out = out.join(F.broadcast(table), "leaf", "left").withColumn("leaf", F.when(F.col("_dim").isNull(), F.col("leaf")).otherwise(below)).drop("_dim", "_split")
    return out


def _above(node: int, names: set[int]) -> int:
    """How many of ``names`` stand above a node."""
    n = 0
    while node > 1:
        node //= 2
        n += node in names
    return n


def boxes(placed: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """(leaf, n, low, high): the rows of each leaf, and the least and greatest value of each dimension in it."""
    at = [F.get(F.col(column), F.lit(k)).cast("double") for k in range(dim)]
    return placed.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*[F.min(x) for x in at]).alias("low"), F.array(*[F.max(x) for x in at]).alias("high"))


def box_distance(query: Column) -> Column:
    """The least distance that a row in a box (low, high) can have from ``query``, an array of doubles."""
    sides = F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gaps = F.zip_with(sides, query, lambda s, x: gap(s["a"], s["b"], x).cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The same for one query and many boxes (row by row), rounded down: never more than a row's distance as it is computed."""
    return np.sqrt((np.maximum(np.maximum(low - q, q - high), 0.0) ** 2).sum(1)) * (1 - 1e-9)


def gap_sums(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far ``q`` lies outside each box, summed over the dimensions: never less than the distance."""
    return np.maximum(np.maximum(low - q, q - high), 0.0).sum(1)
