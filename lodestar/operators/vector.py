"""Exact range and nearest-neighbour search by Euclidean distance over (vec_id, embedding, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import l2


def distances(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``vectors`` with dist to a literal query; no shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("dist", l2(F.col("embedding"), q))


def in_range(vectors: DataFrame, query: list[float], radius: float) -> DataFrame:
    return distances(vectors, query).where(F.col("dist") < radius)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` nearest with rank; each task keeps its own ``k`` before they meet."""
    best = distances(vectors, query).orderBy("dist", "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("dist", "vec_id")))


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, blocks: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, dist) for each row of ``queries`` against all of ``vectors`` but itself.

    Queries go along with each of ``blocks`` blocks of vectors as one bounded group; each block keeps its own ``k`` for a
    query, so that the final ranking sees blocks x k rows of each query. Distances stay in the JVM.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    data = vectors.select("vec_id", "embedding", block.alias("block"))
    asks = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = data.join(asks, "block").where("vec_id <> query_id").select("query_id", "block", "vec_id", l2(F.col("embedding"), F.col("query")).alias("dist"))
    local = Window.partitionBy("block", "query_id").orderBy("dist", "vec_id")
    whole = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    kept = pairs.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def nearest_per_label(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(label, vec_id, dist): the nearest of each label."""
    best = distances(vectors, query).groupBy("label").agg(F.min(F.struct("dist", "vec_id")).alias("m"))
    return best.select("label", "m.vec_id", "m.dist")


def leaf_radius_range(vectors: DataFrame, query: list[float], leaf: int, k: int) -> DataFrame:
    """All vectors nearer than the farthest one of the query's own leaf (a label stands for a leaf)."""
    far = distances(vectors, query)
    radius = far.where(F.col("label") == leaf).orderBy(F.col("dist").desc(), "vec_id").limit(k).agg(F.max("dist")).first()[0]
    return far.where(F.col("dist") < F.lit(radius))
