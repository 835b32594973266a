"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import new_path, remove, settle


def _star(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (u, v) and, for each u, the least of its neighbours and itself."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return arcs, least


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arcs, least = _star(both)
    out = arcs.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    arcs, least = _star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    out = arcs.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), v being the lesser, are stars already: no node is twice a ray, or both a ray and a centre."""
    rays = edges.select(F.col("u").alias("node"), F.lit(1).alias("ray"), F.lit(0).alias("centre"))
    ends = rays.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.sum("ray") + F.max("centre")).alias("roles")).where("roles > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long), component being the least node reachable.

    Each round is two aggregations and two joins; a star's centre is split by adaptive skew joins. Rounds grow with the
    logarithm of the longest chain, and end once all edges are stars, for which one aggregation is enough; edges that are stars from
    the first on take none. Each round's edges go to the shared folder, so that no lineage builds up.
    """
    spark = edges.sparkSession
    path = new_path(spark, name)
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, path)
    while not _are_stars(now):
        old, path = path, new_path(spark, name)
        now = settle(_small(_large(now)), name, path)
        remove(spark, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
