"""Vector codes: vectors cut into parts, each named by its nearest entry of a codebook, found by exponion search.

Components are integers, floor(``SCALE`` * x). A codebook starts with that part of the ``ENTRIES`` smallest vec_ids; each
of ``ROUNDS`` rounds assigns all parts to their nearest entries and moves each entry to the floor of its parts' mean.

Exponion search. A part starts at its entry of the round before, at squared distance u. An entry as near as that lies,
by the triangle inequality, within twice the root of u from it: a squared gap of 4 u at most. So the start's list of
all entries, sorted by their gaps to it, is scanned only up to that radius. Distances are exact integers; of entries
equally near, the lower index wins, and the radius includes its edge, so that none of them is missed.

On Spark. Tasks assign batches of rows and sum parts by entry; sums are added up by Spark and come to the driver as
``PARTS`` * ``ENTRIES`` rows of one part's length, whatever the table's size; codebooks go to tasks the same way. Rows are
written with their codes after each round, in place of those before.

Defined cases. Rows whose vector is null, empty or holds null or non-finite components take no part, nor do those whose
length is not that of the smallest vec_id's vector. That length must be a multiple of ``PARTS`` (ValueError), and
components so large that squared distances might leave 64 bits are an error in the task. Null vec_ids come last; equal
vec_ids are ordered by their vectors, and each row counts. With fewer than ``ENTRIES`` rows, codebooks are shorter; with
none there are no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.kept import forget
from lodestar.storage import new_path, remove, settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS = 8192


def nearest(points: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each point and its squared distance, beginning with the entries ``before``; and how many
    distances were computed."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    reach = -(-np.take_along_axis(gaps, order, 1) // 4)  # the least squared distance of a start that reaches so far
    first = ((points - book[before]) ** 2).sum(1)
    entry, best, live, done = before.copy(), first.copy(), np.arange(len(points)), len(points)
    for k in range(len(book)):
        live = live[reach[before[live], k] <= first[live]]
        if not len(live):
            break
        j = order[before[live], k]
        d = ((points[live] - book[j]) ** 2).sum(1)
        better = (d < best[live]) | ((d == best[live]) & (j < entry[live]))
        entry[live[better]], best[live[better]] = j[better], d[better]
        done += len(live)
    return entry, best, done


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long vectors by row and part."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, dim // PARTS)
    limit = math.isqrt(2**61 // (dim // PARTS)) // 2
    if flat.size and max(-int(flat.min()), int(flat.max())) > limit:
        raise ValueError(f"components beyond {limit / SCALE:.4g} have no exact 64-bit distances")
    return flat


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS).astype(np.int64)


def _pieces(batches):
    for b in batches:
        for first in range(0, b.num_rows, ROWS):
            yield b.slice(first, ROWS)


def integers(embeddings: DataFrame, rest: tuple[str, ...] = ("label",)) -> tuple[DataFrame, int, list[list[int]]]:
    """The rows that take part (vec_id, rest, vec, code: all entry 0, error), their dimension, and the vectors of the
    ``ENTRIES`` smallest vec_ids."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    kept = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    vec = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    kept = kept.select("vec_id", *rest, vec.alias("vec"))
    head = lambda df, n: [r["vec"] for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(n).collect()]
    first = head(kept, 1)
    dim = len(first[0]) if first else PARTS
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components have no {PARTS} equal parts")
    kept = kept.where(F.size("vec") == dim)
    start = head(kept, ENTRIES)
    return kept.withColumns({"code": F.lit(bytes(PARTS)), "error": F.lit(0).cast("long")}), dim, start


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with each part's nearest entry, searched from the entry it had, and the squared distances' sum."""
    dim = books.shape[0] * books.shape[2]
    at_vec, at_code, at_error = (rows.columns.index(c) for c in ("vec", "code", "error"))

    def run(batches):
        forget()
        for b in _pieces(batches):
            points, before = _matrix(b.column(at_vec), dim), _codes(b.column(at_code))
            found = [nearest(points[:, p], books[p], before[:, p]) for p in range(PARTS)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            columns = list(b.columns)
            columns[at_code] = pa.array([r.tobytes() for r in code], pa.binary())
            columns[at_error] = pa.array(np.sum([f[1] for f in found], axis=0), pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    _, m, d = books.shape
    slim = rows.select("vec", "code")

    def run(batches):
        sums, used = np.zeros((PARTS * m, d + 1), np.int64), False
        for b in _pieces(batches):
            points, code = _matrix(b.column(0), PARTS * d), _codes(b.column(1))
            cell = (code + np.arange(PARTS) * m).ravel()
            np.add.at(sums[:, :d], cell, points.reshape(-1, d))
            np.add.at(sums[:, d], cell, 1)
            used = True
        if used:
            at = np.flatnonzero(sums.any(axis=1).repeat(d + 1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at], pa.int64())], names=["at", "total"])

    totals = np.zeros((PARTS, m, d + 1), np.int64)
    for r in slim.mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect():
        totals.flat[r["at"]] = r["total"]
    count = totals[..., d:]
    return np.where(count > 0, totals[..., :d] // np.maximum(count, 1), books)


def learn(embeddings: DataFrame, rest: tuple[str, ...] = ("label",)) -> tuple[DataFrame, np.ndarray]:
    """The rows that take part with their final codes and errors, a written table, and the codebooks (part, entry, place)."""
    spark = embeddings.sparkSession
    rows, dim, start = integers(embeddings, rest)
    books = np.array(start, np.int64).reshape(len(start), PARTS, dim // PARTS).transpose(1, 0, 2)
    old = None
    for k in range(ROUNDS + 1):
        path = new_path(spark, "codes")
        rows = settle(assigned(rows, books) if len(start) else rows, "codes", path)
        if old:
            remove(spark, old)
        old = path
        if k < ROUNDS and len(start):
            books = moved(rows, books)
    return rows, books


def decoded(code: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(code)]) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13(embeddings: DataFrame) -> DataFrame:
    rows, books = learn(embeddings.select("vec_id", "embedding", "label"))
    per = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(per, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
