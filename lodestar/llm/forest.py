"""Approximate nearest neighbours by inner product with a hash-prefix forest.

The index. A bit of a hash string is the side of a random hyperplane on which a vector lies, after one more component has
made all vectors equally long, so that the largest inner product is the nearest direction. A tree is the sorted array of
``BITS``-bit hash strings of all rows; a prefix is a range of it. Each of ``ROUTES`` trees over the whole table is cut by
prefix into blocks of ``block_rows`` rows or so, and in each block ``TREES`` further trees, with planes of their own, index the
block's rows. No row is left out; a prefix that many copies of one vector share is cut by a hash of vec_id.

A search in a block descends in each of its trees to the longest prefix that any row shares with the query, then ascends in
all trees at once, one bit at a time, and scores the rows that it meets in double precision on the original vectors. Two
vectors at an angle share a bit with probability p = 1 - angle / pi, so that a row as near as the k-th found is still
unmet after an ascent to depth x in t trees with probability (1 - p^x)^t; the ascent ends, within a level if need be, as soon
as that is below ``MISS``. Nearby neighbours therefore end it early, and vectors that are nearly at random, as embeddings of
unrelated things are, only high up: no share of the rows is fixed.

The same rule chooses blocks. Each query first searches its own block of the first route. With its k-th score known, the
number of routes m and the depth x are chosen that make the miss at most ``MISS`` with the fewest rows, m / 2^x of all; blocks
of those prefixes that it has not seen are searched, with the known score as a floor. Rows go only to blocks that some
query visits. A block that more than ``chunk_rows`` queries visit is searched by several tasks, each with its share of
the queries; a lost task is run again from shuffled rows.

Defined cases. Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows whose
vec_id is null. Rows of the query's own vec_id are not its neighbours; of rows that repeat a vec_id, one is the query, and
each is a neighbour of others. Vectors are compared with those of their own length only. Ties go to the smaller vec_id. Extra
columns are left out. No rows: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.kept import forget
from lodestar.storage import new_path, remove, settle

ROUTES, TREES, BITS, MISS = 4, 64, 32, 0.07
BLOCK_ROWS, CHUNK_ROWS = 8192, 4096
#: Bits of a route's strings by which blocks are cut: so many prefixes are counted, whatever the table's size.
CUT_BITS = 14


def planes(dim: int, strings: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, strings * bits)).astype(np.float32)


def codes(x: np.ndarray, last: np.ndarray, by: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hash strings as numbers, (strings, rows): the first bit is the highest. ``last`` is the further component."""
    full = np.column_stack([x, last])
    scale = np.maximum(np.abs(full).max(axis=1, keepdims=True), 1e-300)
    side = ((full / scale).astype(np.float32) @ by > 0).reshape(len(full), -1, bits)
    return (side @ (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)).T.copy()


def shared_bit(score: np.ndarray, length: np.ndarray, longest: float) -> np.ndarray:
    """The probability that a query of that length and a row of that score share a bit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.nan_to_num(score / (length * longest), nan=-1.0, posinf=-1.0, neginf=-1.0)
    return 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi


class Forest:
    """Trees over the rows of ``x`` (double), in order of ids. ``longest`` is the length of the table's longest vector."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = 5):
        self.x, self.ids, self.longest, self.bits, self.trees = x, ids, longest, bits, trees
        self.planes = planes(x.shape[1], trees, bits, seed)
        own = codes(x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0)), self.planes, bits)
        order = np.argsort(own, axis=1, kind="stable").astype(np.int32)
        self.sorted, self.order = np.take_along_axis(own, order, 1), order.ravel()
        self.scored = 0

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share the first d bits with each query lie in each tree: first and end (d, tree, query)."""
        own = codes(q, np.zeros(len(q)), self.planes, self.bits)
        low, high = (np.empty((self.bits + 1, *own.shape), np.int32) for _ in range(2))
        rest = self.bits - np.arange(self.bits + 1)[:, None]
        for t in range(self.trees):
            prefix = own[t] >> rest << rest
            low[:, t] = np.searchsorted(self.sorted[t], prefix, "left")
            high[:, t] = np.searchsorted(self.sorted[t], prefix + (1 << rest) - 1, "right")
        return low, high

    def search(self, q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, k: int, miss: float = MISS):
        """Yields (query id, rows, scores) of the best ``k`` rows met, best first, ties to smaller ids. ``floors`` are the
        k-th scores found elsewhere, minus infinity for none."""
        step = 256
        for a in range(0, len(q), step):
            part = q[a : a + step]
            low, high = self.ranges(part)
            lengths = np.sqrt((part * part).sum(1))
            for i in range(len(part)):
                yield q_ids[a + i], *self._one(part[i], q_ids[a + i], lengths[i], floors[a + i], low[:, :, i], high[:, :, i], k, miss)

    def _one(self, q, q_id, length, floor, low, high, k, miss):
        n = len(self.x)
        met = np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        size = (high - low).sum(1)
        first = np.arange(self.trees, dtype=np.int64) * n

        def take(begin: np.ndarray, end: np.ndarray, offset: np.ndarray) -> None:
            """Meet the rows of ranges of the sorted arrays."""
            nonlocal found, scores
            count = (end - begin).astype(np.int64)
            begin = begin + offset
            flat = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = self.order[flat]
            new = np.zeros(n, bool)
            new[at[~met[at]]] = True
            at = np.flatnonzero(new)
            met[at] = True
            self.scored += len(at)
            at = at[self.ids[at] != q_id]
            found, scores = np.append(found, at), np.append(scores, self.x[at] @ q)
            if len(found) > k:  # the last digits depend on how many are scored at a time
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= edge - 1e-9 * max(1.0, abs(edge))
                found, scores = found[near], scores[near]

        enough = np.flatnonzero(size > k + self.trees)  # the query's own row may be in all trees
        depth = int(enough[-1]) if len(enough) else 0  # the longest matches that may hold k rows
        take(low[depth], high[depth], first)
        while depth > 0:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            p = 1 - math.acos(min(max(max(edge, floor) / (length * self.longest), -1.0), 1.0)) / math.pi
            here, above = (math.log(max(1 - p**d, 1e-300)) for d in (depth, depth - 1))
            goal = math.log(miss)
            if self.trees * here <= goal:
                break
            # of the next level, only as many trees as it takes
            some = self.trees if self.trees * above >= goal else min(self.trees, math.ceil((goal - self.trees * here) / (above - here)))
            # the ranges grow at both ends
            depth, of = depth - 1, slice(0, some)
            take(np.append(low[depth, of], high[depth + 1, of]), np.append(low[depth + 1, of], high[depth, of]), np.append(first[of], first[of]))
            if some < self.trees:
                break
        exact = (self.x[found] * q).sum(1)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return found[best], exact[best]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(good).select("vec_id", v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


def routed(rows: DataFrame, longest: dict[int, float], routes: int) -> DataFrame:
    """``rows`` (row, vec_id, v, dim) with the hash strings of all routes, of a row (route) and of a query (ask)."""

    def run(batches):
        forget()
        for b in batches:
            dims = b.column(3).to_numpy()
            out = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(b.column(2).take(pa.array(at)), len(at))
                by = planes(dim, routes, BITS, 17)
                for k, last in enumerate((np.sqrt(np.maximum(longest[dim] ** 2 - (x * x).sum(1), 0)), np.zeros(len(at)))):
                    for i, c in zip(at.tolist(), codes(x, last, by).T.tolist(), strict=True):
                        out[k][i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, pa.list_(pa.int64())) for o in out)], names=["row", "vec_id", "v", "dim", "route", "ask"])

    schema = "row long, vec_id long, v array<double>, dim int, route array<long>, ask array<long>"
    return rows.select("row", "vec_id", "v", "dim").mapInArrow(run, schema)


def cut_blocks(counts: list[tuple[int, int, int, int]], block_rows: int) -> list[tuple[int, int, int, int, int]]:
    """(dim, route, first prefix, block, parts) from the rows of each (dim, route, prefix): runs of prefixes, in order, of
    ``block_rows`` rows or so; a prefix that holds more is cut into parts."""
    out: list[list[int]] = []
    size = 0
    for dim, route, prefix, n in sorted(counts):
        same = bool(out) and out[-1][:2] == [dim, route]
        if not same or size + n > block_rows:
            out.append([dim, route, prefix if same else 0, out[-1][3] + 1 if same else 0, 1])
            size = 0
        size += n
        out[-1][4] = max(1, -(-size // block_rows))
    return [tuple(x) for x in out]


def plan_visits(p: np.ndarray, routes: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the routes and the depth of the fewest rows that miss a row sharing bits with probability p by
    ``miss`` at most."""
    best = np.ones(len(p))
    number, depth = np.ones(len(p), np.int64), np.zeros(len(p), np.int64)
    for m in range(1, routes + 1):
        need = 1 - miss ** (1 / m)  # p^x has to be so much
        with np.errstate(divide="ignore"):
            x = np.where(p >= 1, CUT_BITS, np.floor(np.log(need) / np.minimum(np.log(np.clip(p, 1e-12, 1.0)), -1e-12)))
        x = np.clip(x, 0, CUT_BITS).astype(np.int64)
        cost = m * 0.5**x
        better = cost < best
        best, number, depth = np.where(better, cost, best), np.where(better, m, number), np.where(better, x, depth)
    return number, depth


class Blocks:
    """The blocks of each (dim, route): first prefix, number and parts, in order."""

    def __init__(self, blocks: list[tuple[int, int, int, int, int]], longest: dict[int, float], routes: int):
        self.tables = {key: np.array([b[2:] for b in blocks if b[:2] == key]) for key in {b[:2] for b in blocks}}
        self.longest, self.routes = longest, routes

    def of(self, dim: int, route: int, prefixes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tables[dim, route][:, 0], prefixes, "right") - 1

    def homes(self, dim: int, strings: np.ndarray, rows: np.ndarray) -> list[list[dict]]:
        """Where rows of given hash strings lie: a block and a part of it in each route."""
        out: list[list[dict]] = [[] for _ in rows]
        spread = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for route in range(self.routes):
            block = self.of(dim, route, strings[:, route] >> (BITS - CUT_BITS))
            part = spread % self.tables[dim, route][block, 2]
            for o, b, x in zip(out, block.tolist(), part.tolist(), strict=True):
                o.append({"route": route, "block": b, "part": x})
        return out

    def visits(self, dim: int, strings: np.ndarray, lengths: np.ndarray, floors: np.ndarray | None, miss: float):
        """(query, route, block, part) for queries of given strings and lengths: all blocks of the routes and depths that
        their k-th scores call for, but for their own block of the first route; without scores just that one."""
        number, depth = np.ones(len(strings), np.int64), np.full(len(strings), CUT_BITS)
        if floors is not None:
            number, depth = plan_visits(shared_bit(floors, lengths, self.longest[dim]), self.routes, miss)
        for route in range(self.routes):
            parts, rest = self.tables[dim, route][:, 2].tolist(), CUT_BITS - depth
            own = strings[:, route] >> (BITS - CUT_BITS)
            first, last = self.of(dim, route, own >> rest << rest), self.of(dim, route, (own >> rest << rest) + (1 << rest) - 1)
            home = self.of(dim, route, own)
            for i in np.flatnonzero(number > route).tolist():
                for block in range(first[i], last[i] + 1):
                    if floors is None or route or block != home[i]:
                        for part in range(parts[block]):
                            yield i, route, block, part


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, routes: int = ROUTES, trees: int = TREES, miss: float = MISS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each row whose vec_id ``every`` divides."""
    spark, paths = vectors.sparkSession, {n: new_path(vectors.sparkSession, n) for n in ("vectors", "routed", "first")}
    base = usable(vectors.select("vec_id", "embedding")).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    base = settle(base, "vectors", paths["vectors"])  # the number is written with the row
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = {r["dim"]: math.sqrt(r["m"]) for r in base.groupBy("dim").agg(F.max(square).alias("m")).collect()}  # one row for each length
    rows = settle(routed(base, longest, routes), "routed", paths["routed"])
    prefixes = F.transform("route", lambda c: F.shiftright(c, BITS - CUT_BITS).cast("int"))
    counts = rows.select("dim", F.posexplode(prefixes).alias("route", "prefix")).groupBy("dim", "route", "prefix").count()
    # 2^CUT_BITS rows for each route at most
    sent = spark.sparkContext.broadcast(Blocks(cut_blocks([tuple(r) for r in counts.collect()], block_rows), longest, routes))

    def place(batches):
        for b in batches:
            dims, strings, numbers = b.column(3).to_numpy(), _matrix(b.column(4), b.num_rows).astype(np.int64), b.column(0).to_numpy()
            at = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                for i, homes in zip(mine.tolist(), sent.value.homes(dim, strings[mine], numbers[mine]), strict=True):
                    at[i] = homes
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("route", "block", "part")]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at, kind)], names=["row", "vec_id", "v", "dim", "at"])

    placed = rows.select("row", "vec_id", "v", "dim", "route").mapInArrow(place, "row long, vec_id long, v array<double>, dim int, at array<struct<route:int,block:int,part:int>>")
    placed = placed.select("row", "vec_id", "v", "dim", F.explode("at").alias("at")).select("row", "vec_id", "v", "dim", "at.*")

    def visiting(known: bool):
        def visits(batches):
            for b in batches:
                dims, strings = b.column(2).to_numpy(), _matrix(b.column(3), b.num_rows).astype(np.int64)
                floors = b.column(4).to_numpy(zero_copy_only=False)
                found = []
                for dim in np.unique(dims).tolist():
                    mine = np.flatnonzero(dims == dim)
                    lengths = np.sqrt(np.square(_matrix(b.column(1).take(pa.array(mine)), len(mine))).sum(1))
                    found += [(dim, int(mine[i]), *where) for i, *where in sent.value.visits(dim, strings[mine], lengths, floors[mine] if known else None, miss)]
                w = np.array(found, np.int64).reshape(-1, 5)
                take = pa.array(w[:, 1])
                yield pa.RecordBatch.from_arrays([*(pa.array(w[:, j].astype(np.int32)) for j in (0, 2, 3, 4)), *(b.column(j).take(take) for j in (0, 1, 4))], names=["dim", "route", "block", "part", "query_id", "q", "floor"])

        return visits

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("vec_id"), right.sort_by("query_id")
            ids, numbers = left["vec_id"].to_numpy(), left["row"].to_numpy()
            forest = Forest(_matrix(left["v"], left.num_rows), ids, longest[key[0].as_py()], trees)
            for q, at, score in forest.search(_matrix(right["q"], right.num_rows), right["query_id"].to_numpy(), right["floor"].to_numpy(), k, miss):
                for o, column in zip(out, (np.full(len(at), q), numbers[at], ids[at], score), strict=True):
                    o.append(column)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({n: join(o, pa.float64() if n == "score" else pa.int64()) for n, o in zip(("query_id", "row", "vec_id", "score"), out, strict=True)})

    key = ["dim", "route", "block", "part"]

    def searched(asks: DataFrame) -> DataFrame:
        """What the visits of ``asks`` find; blocks that nobody visits are not moved."""
        asked = asks.groupBy(*key).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
        data = placed.join(asked, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        dealt = asks.join(asked, key).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")
        by = [*key, "chunk"]
        return data.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(run, "query_id long, row long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min(F.struct("v", "ask")).alias("q")).select("vec_id", "q.v", "dim", "q.ask")
    schema = "dim int, route int, block int, part int, query_id long, q array<double>, floor double"
    none = F.lit(-math.inf)
    first = searched(queries.select("vec_id", "v", "dim", "ask", none.alias("floor")).mapInArrow(visiting(False), schema))
    first = settle(best(first), "first", paths["first"])
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    more = queries.join(known, "vec_id", "left").select("vec_id", "v", "dim", "ask", F.coalesce("known", none).alias("floor"))
    more = searched(more.mapInArrow(visiting(True), schema))
    # routes can meet a row again
    both = first.drop("rank").unionAll(more).groupBy("query_id", "row").agg(F.min("vec_id").alias("vec_id"), F.max("score").alias("score"))
    out = settle(best(both).select("query_id", "rank", "vec_id", "score"), "neighbours")
    for p in paths.values():
        remove(spark, p)
    return out


def op4(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors)
