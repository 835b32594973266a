"""A store of vectors clustered by the leaves of a KD tree, which grows by inserts and reads only the leaves that a search meets.

Layout. ``data/<generation>/shelf=<n>`` holds rows in Parquet, by leaf, ``versions/v=<n>`` a version: its nodes with their splits and boxes, and
of each leaf the rows and the folders that make it up. A shelf is one leaf, or neighbouring leaves that are small beside the insert: an
insert makes ``2 * SHELVES`` folders or so, or as many as its rows fill shelves of ``SHELF_ROWS``, however many leaves it meets. An insert appends rows to their leaves in a generation of its own.
Leaves that become overfull are split: their rows move to the new leaves in the new generation. Then the next version is
written; what was there stays as it was, so that earlier versions can be read, and an insert that fails leaves nothing
but an unnamed folder. There is one writer at a time: the second of two that make the same version gets an error.

Bounds. Nodes number 2^(levels + 1) at most; they are collected and broadcast. Splits are fitted on ``SAMPLE`` rows or so in a
round. A leaf that is larger than a file, as of equal vectors, which no split parts, is dealt to several writers.

Rows need vec_id and embedding, of one length in the whole store; other columns are kept. Rows whose vector is null or
holds nulls or NaN have no distance and are not stored. Repeated rows are stored as often as they come.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import l2
from lodestar.operators import blocks, kdtree
from lodestar.storage import children, local, new_path, remove, settle

#: Rows of a file, and rows and queries (or so) that a task measures against each other at once.
FILE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 500_000, 8192, 2048
#: Leaves share a folder of an insert up to this part of its rows, and up to so many rows.
SHELVES, SHELF_ROWS = 64, 65_536
NODES = "node long, dim int, split double, n long, low array<double>, high array<double>, folders array<string>"


def dealt(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(leaf, first, pieces) of leaves with their rows, in the order of the tree: neighbours share a number up to ``most`` rows; a larger leaf
    has as many of its own, from ``first``, as it fills."""
    deep = max((k.bit_length() for k in sizes), default=0)
    out, now, held = [], -1, most
    for k in sorted(sizes, key=lambda k: k << (deep - k.bit_length())):
        pieces = -(-sizes[k] // most)
        if held + sizes[k] > most:
            now, held = now + 1, 0
        out.append((k, now, pieces))
        now, held = now + pieces - 1, held + sizes[k] if pieces == 1 else most
    return out


class Version:
    """The nodes of one version."""

    def __init__(self, nodes: dict[int, dict], number: int):
        self.nodes, self.number = nodes, number
        self.leaves = sorted(k for k, x in nodes.items() if x["dim"] is None and x["n"])
        self.low, self.high = (np.array([nodes[k][side] for k in self.leaves], float) for side in ("low", "high"))
        self.sizes = np.array([nodes[k]["n"] for k in self.leaves], int)

    def splits(self) -> list[tuple[int, int, float]]:
        return [(k, x["dim"], x["split"]) for k, x in self.nodes.items() if x["dim"] is not None]

    def blocks(self, most: int) -> list[tuple[int, int, int]]:
        """(leaf, first, pieces): neighbouring leaves share a block of ``most`` rows at most; a larger leaf has several of its own, from ``first``."""
        return dealt(dict(zip(self.leaves, self.sizes.tolist(), strict=True)), most)

    def distances(self, q) -> np.ndarray:
        return kdtree.box_distances(np.asarray(q, float), self.low, self.high)


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, leaf_rows: int = 250_000, levels: int = kdtree.LEVELS, sample: int = kdtree.SAMPLE):
        self.spark, self.path, self.leaf_rows, self.levels, self.sample = spark, path, leaf_rows, levels, sample

    def versions(self) -> list[int]:
        return sorted(int(name.removeprefix("v=")) for name in children(self.spark, f"{self.path}/versions") if name.startswith("v="))

    def version(self, number: int | None = None) -> Version:
        """A version, the latest if none is named; before the first insert, one without rows."""
        number = max(self.versions(), default=0) if number is None else number
        if not number:
            return Version({1: {"dim": None, "split": None, "n": 0, "low": None, "high": None, "folders": []}}, 0)
        rows = self.spark.read.schema(NODES).parquet(self._at(number)).collect()
        return Version({r["node"]: {k: r[k] for k in ("dim", "split", "n", "low", "high", "folders")} for r in rows}, number)

    def _at(self, number: int) -> str:
        return f"{self.path}/versions/v={number:06d}"

    def read(self, version: Version, leaves: list[int] | None = None) -> DataFrame:
        """The rows of ``leaves``, or of all, with leaf. Only folders that hold some of them are listed and read."""
        held = sorted({(f, k) for k in (version.leaves if leaves is None else leaves) for f in version.nodes[k]["folders"]})
        if not held:
            some = [x["folders"][0] for x in version.nodes.values() if x["folders"]]
            return self.read_folders(some[:1]).drop("gen", "shelf").limit(0) if some else local(self.spark, [], "vec_id bigint, embedding array<float>, leaf long")
        rows = self.read_folders(sorted({f for f, _ in held}))
        if leaves is not None:
            rows = rows.where(F.col("leaf").isin(list(leaves)))  # what the files' own statistics can use
        # a folder may hold other leaves, and rows of one that were moved since
        mine = local(self.spark, sorted({(f.split("/")[0].removeprefix("gen="), k) for f, k in held}), "gen string, leaf long")
        return rows.join(F.broadcast(mine), ["gen", "leaf"]).drop("gen", "shelf")

    def read_folders(self, folders: list[str]) -> DataFrame:
        """Rows with leaf, gen and shelf."""
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders]).withColumn("gen", F.col("gen").cast("string"))

    # growing

    def _sampled(self, moving: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
        """Some rows of each leaf, up to an equal share of the sample each."""
        share = max(64, self.sample // len(sizes))
        parts = local(self.spark, [(k, min(1.0, share / n)) for k, n in sizes.items()], "leaf long, _p double")
        draw = F.shiftrightunsigned(F.xxhash64("embedding", "vec_id"), 11).cast("double") * F.lit(2.0**-53)
        found = moving.join(F.broadcast(parts), "leaf").where(draw < F.col("_p")).select("leaf", F.col("embedding").cast("array<double>").alias("x")).toArrow()
        if not found.num_rows:
            return {}
        x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
        leaf = found["leaf"].to_numpy()
        return {int(k): x[leaf == k] for k in np.unique(leaf)}

    def insert(self, vectors: DataFrame) -> int:
        """Add rows; returns the number of the version that has them."""
        now = self.version()
        sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c))
        fresh = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
        old = {k: now.nodes[k]["n"] for k in now.nodes if now.nodes[k]["dim"] is None}
        nodes = {k: dict(x) for k, x in now.nodes.items()}
        path = new_path(self.spark, "insert")
        rows = settle(kdtree.descend(fresh, now.splits()), "insert", path)
        made = [path]
        sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
        moved: set[int] = set()  # old leaves that are split
        stuck: set[int] = set()
        while True:
            over = {k: n + old.get(k, 0) for k, n in sizes.items() if n + old.get(k, 0) > self.leaf_rows * (2 if k not in old else 1) and k not in stuck and k.bit_length() <= self.levels}
            if not over:
                break
            back = [k for k in over if old.get(k)]
            moving = rows.where(F.col("leaf").isin(list(over)))
            if back:
                moving = moving.unionByName(self.read(now, back), allowMissingColumns=True)
                moved |= set(back)
            new = kdtree.fit(self._sampled(moving, over), over, self.leaf_rows, self.levels)
            stuck |= set(over) - {k for k, _, _ in new}
            for k in back:
                old[k] = 0
            below = kdtree.descend(moving, new)
            path = new_path(self.spark, "insert")
            rows = settle(rows.where(~F.col("leaf").isin(list(over))).unionByName(below, allowMissingColumns=True), "insert", path)
            made.append(path)
            sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
            for k, dim, split in new:
                nodes[k] = {"dim": dim, "split": split, "n": None, "low": None, "high": None, "folders": []}
                for child in (2 * k, 2 * k + 1):
                    nodes.setdefault(child, {"dim": None, "split": None, "n": 0, "low": None, "high": None, "folders": []})
        if sizes:
            generation = f"gen={now.number + 1:06d}-{uuid.uuid4().hex[:8]}"
            shelf = self._write(rows, sizes, f"{self.path}/data/{generation}")
            dim = rows.select(F.size("embedding").alias("d")).first()["d"]
            for r in kdtree.boxes(rows, dim).collect():
                self._add(nodes[r["leaf"]], r, f"{generation}/shelf={shelf[r['leaf']]}", r["leaf"] in moved)
        self._inner_boxes(nodes)
        flat = [(k, x["dim"], x["split"], x["n"], x["low"], x["high"], x["folders"]) for k, x in sorted(nodes.items())]
        local(self.spark, flat, NODES).coalesce(1).write.parquet(self._at(now.number + 1))
        for path in made:
            remove(self.spark, path)
        return now.number + 1

    @staticmethod
    def _add(leaf: dict, row, folder: str, anew: bool) -> None:
        """A leaf with rows of this generation; ``anew`` if it could not be split and all its rows were moved."""
        kept = not anew and leaf["n"]
        leaf["low"] = np.minimum(leaf["low"], row["low"]).tolist() if kept else row["low"]
        leaf["high"] = np.maximum(leaf["high"], row["high"]).tolist() if kept else row["high"]
        leaf["n"] = (leaf["n"] if kept else 0) + row["n"]
        leaf["folders"] = [*(leaf["folders"] if kept else []), folder]

    @staticmethod
    def _inner_boxes(nodes: dict[int, dict]) -> None:
        for k in sorted((k for k, x in nodes.items() if x["dim"] is not None), reverse=True):
            below = [x for x in (nodes[2 * k], nodes[2 * k + 1]) if x["low"] is not None]
            nodes[k]["n"] = sum(nodes[c]["n"] for c in (2 * k, 2 * k + 1))
            nodes[k]["low"] = np.min([x["low"] for x in below], axis=0).tolist() if below else None
            nodes[k]["high"] = np.max([x["high"] for x in below], axis=0).tolist() if below else None

    def _write(self, rows: DataFrame, sizes: dict[int, int], where: str) -> dict[int, int]:
        """The shelf of each leaf. A leaf that is larger than a file has several, dealt by hash; it shares no shelf."""
        shelf = {k: first for k, first, _ in dealt(sizes, min(SHELF_ROWS, -(-sum(sizes.values()) // SHELVES)))}
        pieces = local(self.spark, [(k, shelf[k], -(-n // FILE_ROWS)) for k, n in sizes.items()], "leaf long, shelf int, _pieces long")
        piece = F.pmod(F.xxhash64("vec_id", "embedding"), F.col("_pieces"))
        dealt_out = rows.join(F.broadcast(pieces), "leaf").withColumn("_piece", piece).repartition("shelf", "_piece").drop("_pieces", "_piece")
        dealt_out.sortWithinPartitions("shelf", "leaf").write.partitionBy("shelf").parquet(where)
        return shelf

    # searching

    def in_range(self, q: list[float], radius: float, version: Version | None = None) -> DataFrame:
        """Rows nearer to ``q`` than ``radius``, with dist. Only leaves whose box comes so near are read."""
        version = version or self.version()
        met = [k for k, d in zip(version.leaves, version.distances(q).tolist(), strict=True) if d < radius] if version.leaves else []
        return self._measured(version, met, q).where(F.col("dist") < radius)

    def _measured(self, version: Version, leaves: list[int], q: list[float]) -> DataFrame:
        return self.read(version, leaves).withColumn("dist", l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])))

    def nearest(self, q: list[float], k: int, version: Version | None = None) -> DataFrame:
        """The ``k`` nearest rows with rank and dist, exactly: the k-th of the leaves nearest to ``q`` that hold so many rows bounds
        which others count."""
        version = version or self.version()
        far = version.distances(q) if version.leaves else np.zeros(0)
        order = np.argsort(far, kind="stable")
        enough = int(np.searchsorted(np.cumsum(version.sizes[order]), k)) + 1
        first = self._measured(version, [version.leaves[i] for i in order[:enough]], q).orderBy("dist").limit(k).agg(F.count("*"), F.max("dist")).first()
        radius = first[1] if first[0] == k else float("inf")
        met = [version.leaves[i] for i in order if far[i] <= radius]
        best = self._measured(version, met, q).orderBy("dist", "vec_id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy("dist", "vec_id")))

    def nearest_of_each(self, queries: DataFrame, k: int, version: Version | None = None, step: int = 4) -> DataFrame:
        """(query_id, rank, vec_id, dist): for each row of ``queries`` (vec_id, embedding) the ``k`` nearest rows of another vec_id.

        Rounds: a query visits its own leaf, whose k-th distance is its radius. The other leaves whose boxes come so near are
        taken by blocks, each of some whole leaves or of a part of a large one, ``BLOCK_ROWS`` rows at most; the nearest blocks
        first, ``step`` times as many in each round, as long as the query's radius, which shrinks, meets them. Only leaves that some query
        of the round meets are read. A task measures a block against ``BLOCK_QUERIES`` queries or so at once (``blocks``), so that neither
        a large leaf nor a block that many queries meet is one task's, and each of them keeps its own ``k``. Queries whose vector is not of the
        store's length, or holds nulls, have no distance and no rows.
        """
        version, spark = version or self.version(), self.spark
        made: list[str] = []

        def table(df, name):
            made.append(new_path(spark, name))
            return settle(df, name, made[-1])

        sound = F.col("embedding").isNotNull() & (F.size("embedding") == version.low.shape[-1]) & F.forall("embedding", lambda c: c.isNotNull())
        asks = queries.where(F.col("vec_id").isNotNull() & sound if version.leaves else F.lit(False)).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")).dropDuplicates(["query_id"])
        asks = table(kdtree.descend(asks, version.splits(), "query").withColumnRenamed("leaf", "own"), "asks")
        order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        dealt = version.blocks(BLOCK_ROWS)
        places = local(spark, dealt, "leaf long, first int, pieces int")
        measured = blocks.measure(k)

        def visit(turn, leaves, own):
            """(query_id, vec_id, dist): the ``k`` nearest rows of each block for each query of ``turn`` (query_id, block, query, own, radius),
            among rows of the query's own leaf, or else among all others."""
            met = {r["block"]: r["count"] for r in turn.groupBy("block").count().collect()}
            shares = local(spark, [(b, -(-n // BLOCK_QUERIES)) for b, n in met.items()], "block int, shares int")
            rows = self.read(version, leaves).where("vec_id is not null").select("leaf", "vec_id", F.col("embedding").cast("array<double>").alias("x")).join(F.broadcast(places), "leaf")
            rows = rows.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "x"), "pieces")).cast("int")).join(F.broadcast(shares), "block")
            rows = rows.select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "leaf", "vec_id", "x")
            each = turn.join(F.broadcast(shares), "block").select("block", F.pmod(F.hash("query_id"), "shares").alias("share"), "query_id", "query", "own", "radius", F.lit(own).alias("inside"))
            return rows.groupBy("block", "share").cogroup(each.groupBy("block", "share")).applyInArrow(measured, "query_id long, vec_id long, dist double")

        here = asks.where(F.col("own").isin(version.leaves)).withColumn("radius", F.lit(None).cast("double"))
        pieces = here.join(F.broadcast(places), F.col("own") == F.col("leaf")).select("query_id", "query", "own", "radius", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1)).alias("block"))
        found = table(best(visit(pieces, sorted(r["own"] for r in here.select("own").distinct().collect()), True)), "found")
        radius = lambda df: df.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("dist")).alias("radius"))
        todo = asks.join(radius(found), "query_id", "left").select("query_id", "query", "own", "radius")
        todo = todo.mapInArrow(blocks.met(spark, version, dealt), "query_id long, block int, far double, leaves array<long>")
        todo = table(todo.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "block"))), "todo")
        low, high = 0, step
        while True:
            turn = todo.where((F.col("turn") > low) & (F.col("turn") <= high)).join(radius(found), "query_id", "left")
            turn = turn.where(F.col("radius").isNull() | (F.col("far") <= F.col("radius")))
            leaves = sorted(r["leaf"] for r in turn.select(F.explode("leaves").alias("leaf")).distinct().collect())
            if not leaves:  # later ones are farther still
                break
            seen = visit(turn.select("query_id", "block", "radius").join(asks, "query_id"), leaves, False)
            found = table(best(found.select("query_id", "vec_id", "dist").unionByName(seen)), "found")
            low, high = high, high * step
        out = found.select("query_id", "rank", "vec_id", "dist")
        kept = max(i for i, path in enumerate(made) if "/found-" in path)
        for path in made[:kept] + made[kept + 1 :]:
            remove(spark, path)
        return out
