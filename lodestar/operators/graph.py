"""All-pairs shortest paths over edges (src, dst, w) by min-plus squaring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import new_path, remove, settle


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(src, dst, dist) of all pairs joined by a path of an edge or more; a vertex's own distance is its shortest cycle.

    Each round joins the table with itself and doubles the edges that a path may have, until nothing changes; rounds are
    bounded by the logarithm of the number of vertices, beyond which only a negative cycle would go on.
    """
    path = new_path(edges.sparkSession, "paths")
    now = settle(edges.groupBy("src", "dst").agg(F.min("w").cast("bigint").alias("dist")), "paths", path)
    vertices = max(2, now.select("src").union(now.select("dst")).distinct().count())
    sign = None
    for _ in range((vertices - 1).bit_length() + 1):
        left = now.select("src", F.col("dst").alias("via"), F.col("dist").alias("d1"))
        right = now.select(F.col("src").alias("via"), "dst", F.col("dist").alias("d2"))
        longer = left.join(right, "via").select("src", "dst", (F.col("d1") + F.col("d2")).alias("dist"))
        old, path = path, new_path(edges.sparkSession, "paths")
        now = settle(now.unionByName(longer).groupBy("src", "dst").agg(F.min("dist").alias("dist")), "paths", path)
        remove(edges.sparkSession, old)
        new = tuple(now.agg(F.count("*"), F.sum("dist")).first())
        if new == sign:
            break
        sign = new
    return now


def negative_cycles(paths: DataFrame) -> DataFrame:
    """One row: whether a vertex lies on a cycle of negative weight, how many do, and the least cycle weight."""
    own = paths.where("src = dst")
    return own.agg((F.count_if(F.col("dist") < 0) > 0).alias("has_negative_cycle"), F.count_if(F.col("dist") < 0).alias("n_vertices"), F.min("dist").alias("least_cycle"))


def routes(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, dist, hops, route) of a shortest path of each pair of different vertices; of equal ones, the least next
    vertex is taken at each step. Weights are positive. A route goes on with the route that its last stop has so far, so
    that rounds double the hops: their number is the logarithm of the longest route's."""
    e = edges.groupBy("src", "dst").agg(F.min("w").cast("bigint").alias("w")).select("src", F.col("dst").alias("via"), "w")
    whole = paths.where("src <> dst")
    rest = paths.select(F.col("src").alias("via"), "dst", F.col("dist").alias("rest")).where("via <> dst")
    steps = whole.join(e, "src").join(rest, ["via", "dst"], "left")
    ok = F.when(F.col("via") == F.col("dst"), F.col("w") == F.col("dist")).otherwise(F.col("w") + F.col("rest") == F.col("dist"))
    nxt = steps.where(ok).groupBy("src", "dst", "dist").agg(F.min("via").alias("at"))
    name = new_path(edges.sparkSession, "routes")
    now = settle(nxt.select("src", "dst", "dist", "at", F.array("at").alias("stops")), "routes", name)
    while not (now.where("at <> dst").isEmpty()):
        on = now.select(F.col("src").alias("at"), "dst", F.col("at").alias("on"), F.col("stops").alias("more"))
        longer = now.join(on, ["at", "dst"], "left").select("src", "dst", "dist", F.coalesce("on", "at").alias("at"), F.concat("stops", F.coalesce("more", F.array().cast("array<int>"))).alias("stops"))
        old, name = name, new_path(edges.sparkSession, "routes")
        now = settle(longer, "routes", name)
        remove(edges.sparkSession, old)
    route = F.concat_ws(">", F.concat(F.array(F.col("src")), "stops").cast("array<string>"))
    return now.select("src", "dst", "dist", F.size("stops").alias("hops"), route.alias("route"))
