"""Rules that hold for any input, and worked examples."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import dedup, graph, merge, partition, regions, runner, vector

READS = "qname string, dedup_key string, flag int, rname string, pos bigint"


@pytest.fixture(scope="module")
def keys(spark):
    rows = [(f"q{k}{i}", f"k{k}") for k in range(1, 5) for i in range(k)]
    return spark.createDataFrame(rows, "qname string, dedup_key string")


@pytest.mark.parametrize("least", [2, 3, 4])
def test_thresholds(keys, rows, least):
    assert rows(dedup.duplicate_keys(keys, least), "dedup_key", "n_extra", "rep_qname") == [(f"k{k}", k - 1, f"q{k}0") for k in range(least, 5)]


def test_marking_keeps_one_and_is_idempotent(spark, keys, rows):
    reads = keys.select("qname", "dedup_key", F.lit(16).alias("flag"), F.lit("chr1").alias("rname"), F.lit(5).cast("bigint").alias("pos"))
    marked = dedup.mark_representative_kept(reads, keys)
    assert marked.where(~F.col("is_dup")).groupBy("dedup_key").agg(F.countDistinct("qname").alias("n")).where("n <> 1").isEmpty()
    again = dedup.mark_representative_kept(marked.drop("is_dup"), keys)
    assert rows(again, "qname", "flag") == rows(marked, "qname", "flag")
    assert rows(dedup.nonfirst_members(keys)) == rows(dedup.window_nonfirst(keys).select("dedup_key", "qname"))


def test_marking_variants(spark):
    reads = spark.createDataFrame([("a", "k", 0, "c", 1), ("a", "k", 0, "c", 2), ("b", "k", 0, "*", 3), ("d", "x", 0, "c", 4)], READS)
    keys = spark.createDataFrame([("a", "k", 0, 0), ("b", "k", 0, 0), ("d", "x", 1, 0)], "qname string, dedup_key string, un1 int, un2 int")
    hit = lambda df: sorted((r["qname"], r["pos"]) for r in df.where("is_dup").collect())
    assert hit(dedup.mark_representative_kept(reads, keys)) == [("b", 3)]
    assert hit(dedup.mark_all_mapped(reads, keys)) == [("a", 1), ("a", 2), ("b", 3)]
    assert hit(dedup.mark_representatives(reads, keys)) == [("a", 1), ("a", 2)]
    assert hit(dedup.mark_multiread(reads)) == [("a", 1), ("a", 2)]
    assert hit(dedup.mark_tagged(reads, keys, 2)) == [("a", 1), ("a", 2), ("b", 3)]
    assert hit(dedup.mark_group_head(reads.withColumn("batch", F.lit(0)), keys)) == []
    empty = reads.where("false")
    assert dedup.mark_representative_kept(empty, keys).isEmpty()


def test_plan_example(spark, rows):
    counts = spark.createDataFrame([("chr10", 200), ("chr2", 5), ("*", 1)], "rname string, n bigint")
    plan = partition.plan(counts, 4)
    assert rows(plan, "rname", "parts", "acc") == [("*", 1, 0), ("chr10", 3, 1), ("chr2", 1, 4)]
    assert partition.total_partitions(plan, 4) == 5
    reads = spark.createDataFrame([("a", "k", 0, "chr2", 9), ("b", "k", 0, "chr10", 7), ("c", "k", 0, "new", 7)], READS)
    assert rows(partition.assign(reads, plan), "qname", "pid") == [("a", 4), ("b", 2), ("c", 1)]
    tiny = spark.createDataFrame([("a", 1)], "rname string, n bigint")
    assert rows(partition.plan(tiny, 8), "parts", "acc") == [(1, 0)]


def test_layout(spark):
    df = spark.range(100).select(F.pmod(F.col("id") * 7, F.lit(5)).cast("int").alias("pid"), F.pmod(F.col("id") * 31, F.lit(97)).alias("pos"), F.lit("c").alias("rname"), F.lit("q").alias("qname"), F.lit(0).alias("flag"))
    at = partition.lay_out(df, 5).withColumn("at", F.spark_partition_id())
    assert at.where("at <> pid").isEmpty()


def test_tiles(spark, rows):
    contigs = spark.createDataFrame([("a", 250), ("b", 100), ("c", 1), ("z", 0)], "rname string, length bigint")
    tiles = regions.tiles(contigs, 100)
    assert rows(tiles) == [(0, "a", 0, 100), (1, "a", 100, 200), (2, "a", 200, 250), (3, "b", 0, 100), (4, "c", 0, 1)]
    assert rows(regions.bundles(tiles, 2), "bundle", "n_regions") == [("region00.txt", 2), ("region01.txt", 2), ("region02.txt", 1)]


def test_merge_plans(spark):
    parts = spark.createDataFrame([(f"d/p{i:02d}", "c-1") for i in range(7)] + [("d/p00", "*")], "path string, rname string")
    one = merge.level_one(merge.files_by_contig(parts), "o")
    assert [(r["rname"], r["n_files"], r["target"]) for r in one.orderBy("file_idx").collect()] == [("*", 1, "o/000000-*.merged"), ("c-1", 5, "o/000001-c-1.merged"), ("c-1", 2, "o/000002-c-1.merged")]
    two = merge.level_two(one, "f").orderBy("out_idx").collect()
    assert [(r["rname"], r["action"]) for r in two] == [("c-1", "merge"), ("*", "move")]
    assert two[1]["command"] == "mv o/000000-*.merged f/Output1.bam"
    sizes = spark.createDataFrame([("a", 5), ("b", 1), ("c", 3), ("d", 4), ("e", 2)], "part string, bytes bigint")
    assert [r["part"] for r in merge.alternating(sizes).orderBy("seq").collect()] == ["a", "b", "d", "e", "c"]


def test_runner(spark):
    plan = spark.createDataFrame([("sh -c 'exit 3'",), ("true",), ("no-such-tool",)], "command string")
    assert [r["code"] for r in runner.run_commands(plan, 2).collect()] == [None, None, None]
    assert sorted(r["code"] for r in runner.run_commands(plan, 2, dry=False).collect()) == [0, 3, 127]


def test_shortest_paths(spark):
    edges = [(0, 1, 50), (0, 2, 10), (0, 4, 45), (1, 2, 15), (2, 0, 20), (2, 3, 15), (3, 1, 20), (3, 4, 35), (4, 3, 30), (5, 3, 3)]
    df = spark.createDataFrame(edges, "src int, dst int, w int")
    paths = graph.shortest_paths(df)
    d = {(r["src"], r["dst"]): r["dist"] for r in paths.collect()}
    assert [d[0, 1], d[0, 3], d[2, 1], d[5, 1], d[5, 4]] == [45, 25, 35, 23, 38]
    assert [d.get((i, i)) for i in range(6)] == [30, 50, 30, 50, 65, None]
    assert not [k for k in d if k[1] == 5]
    route = {(r["src"], r["dst"]): r["route"] for r in graph.routes(df, paths).collect()}
    assert route[0, 1] == "0>2>3>1"
    assert graph.negative_cycles(paths).first()[:] == (False, 0, 30)
    bad = spark.createDataFrame([(0, 1, 1), (1, 0, -2)], "src int, dst int, w int")
    assert graph.negative_cycles(graph.shortest_paths(bad)).first()["has_negative_cycle"]


def test_vector_search(spark, rows):
    v = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(8)], "vec_id bigint, embedding array<float>, label int")
    assert rows(vector.in_range(v, [0.0, 0.0], 2.0), "vec_id") == [(0,), (1,)]
    assert rows(vector.nearest(v, [3.1, 0.0], 3), "rank", "vec_id") == [(1, 3), (2, 4), (3, 2)]
    assert rows(vector.nearest_per_label(v, [0.0, 0.0]), "label", "vec_id") == [(0, 0), (1, 1)]
    got = rows(vector.nearest_of_each(v, v.where("vec_id in (0, 7)"), 2, blocks=3), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 1), (0, 2, 2), (7, 1, 6), (7, 2, 5)]
    assert rows(vector.leaf_radius_range(v, [0.0, 0.0], 0, 2), "vec_id") == [(i,) for i in range(6)]
