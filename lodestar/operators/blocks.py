"""Blocks of vectors measured against blocks of queries, exactly, inside tasks.

Products of matrices leave a few rows of a block for each query, with room for their rounding; these are measured as
``functions.vectors.l2`` does, term by term in the same order, so that distances and ties are the same as there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Queries whose products with a block's rows are held at once, pairs that are measured at once, and queries held against all boxes.
TILE, PAIRS, ASKED = 256, 1 << 16, 256


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), float).reshape(len(whole), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of ``x`` from the same of ``y``; its terms are added in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - y[:, j]
        total += gap * gap
    return np.sqrt(total)


def nearest(x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, q: np.ndarray, asked: np.ndarray, own: np.ndarray, radius: np.ndarray, inside: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows for each query, ties to smaller ids; NaN is the farthest. Rows of the query's
    own id never count, and rows of its own leaf just if ``inside``. What is farther than ``radius`` (NaN: none) may be left out."""
    with np.errstate(all="ignore"):
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        out = xx + qq[:, None] - 2 * (q @ x.T)
        room = 1e-15 * (x.shape[1] + 8) * (xx.max(initial=0.0) + qq)
        limit = np.where(np.isnan(radius), np.inf, radius * radius * (1 + 1e-12) + room)
    barred = (ids == asked[:, None]) | ((leaf == own[:, None]) != inside)
    sound = np.isfinite(out).all() and np.isfinite(room).all()
    if sound:
        out[barred] = np.inf
        many = np.flatnonzero((out <= limit[:, None]).sum(1) > k)
        if len(many):
            limit[many] = np.minimum(limit[many], np.partition(out[many], k - 1, axis=1)[:, k - 1] + 2 * room[many])
        at, row = np.nonzero((out <= limit[:, None]) & ~barred)
    else:  # some value is not finite, or too large to square
        at, row = np.nonzero(~barred)
    with np.errstate(all="ignore"):
        far = np.concatenate([np.zeros(0), *[distances(x[row[i : i + PAIRS]], q[at[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]])
    order = np.lexsort((ids[row], far, at))
    at, row, far = at[order], row[order], far[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], row[rank < k], far[rank < k]


def measure(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogroups of rows (leaf, vec_id, x) and queries (query_id, query, own, radius, inside) of one block."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asks.num_rows:
            x, ids, leaf = matrix(rows["x"]), rows["vec_id"].to_numpy(), rows["leaf"].to_numpy()
            inside = asks["inside"][0].as_py()
            for i in range(0, asks.num_rows, TILE):
                some = asks.slice(i, TILE)
                asked = some["query_id"].to_numpy()
                radius = np.asarray(some["radius"].to_numpy(), float)
                at, row, far = nearest(x, ids, leaf, matrix(some["query"]), asked, some["own"].to_numpy(), radius, inside, k)
                parts.append((asked[at], ids[row], far))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["query_id", "vec_id", "dist"])

    return run


def met(spark: SparkSession, version, dealt: list[tuple[int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, block, far, leaves) of queries (query_id, query, own, radius): the blocks of leaves, but for the query's own, whose boxes
    come as near to it as its radius (none: all), the nearest distance of these, and which they are. ``dealt``: (leaf, first, pieces)."""
    order = {k: i for i, k in enumerate(version.leaves)}
    at = [order[k] for k, _, _ in dealt]
    boxes = np.ascontiguousarray(version.low[at].T) if at else None, np.ascontiguousarray(version.high[at].T) if at else None
    sent = spark.sparkContext.broadcast((*boxes, np.array(dealt, np.int64).reshape(-1, 3)))

    def run(batches):
        low, high, deal = sent.value
        leaf, first, pieces = deal.T
        for whole in batches:
            for i in range(0, whole.num_rows, ASKED):
                b = whole.slice(i, ASKED)
                q, own = matrix(b.column(1)), b.column(2).to_numpy()
                radius = np.asarray(b.column(3).to_numpy(zero_copy_only=False), float)
                radius = np.where(np.isnan(radius), np.inf, radius)
                far = np.zeros((len(q), len(leaf)))
                with np.errstate(all="ignore"):
                    for j in range(q.shape[1]):  # fmax: what is not a number keeps no leaf out
                        gap = np.fmax(np.fmax(low[j] - q[:, j, None], q[:, j, None] - high[j]), 0.0)
                        far += gap * gap
                far = np.sqrt(far) * (1 - 1e-9)  # never more than a row's distance as it is computed
                ask, hit = np.nonzero((far <= radius[:, None]) & (leaf != own[:, None]))
                if not len(ask):
                    continue
                # ``dealt`` is in the order of blocks: runs of one query and first block are one row, or one for each piece
                cut = np.flatnonzero(np.append(True, (np.diff(ask) != 0) | (np.diff(first[hit]) != 0)))
                near, many = np.minimum.reduceat(far[ask, hit], cut), pieces[hit[cut]]
                again = np.repeat(np.arange(len(cut)), many)
                step = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                held = pa.ListArray.from_arrays(pa.array(np.append(cut, len(hit)).astype(np.int32)), pa.array(leaf[hit]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ask[cut][again])), pa.array((first[hit[cut]][again] + step).astype(np.int32)), pa.array(near[again]), held.take(pa.array(again))],
                    names=["query_id", "block", "far", "leaves"],
                )

    return run
