"""What is shuffled, counted or made once, so that a task's share does not grow with the input."""

from lodestar.operators import strides
from lodestar.plans import queries, views
from lodestar.sinks import sorted_reads
from lodestar.streaming import frames as streams

DATA = "/root/testdata/sf0.001"


def test_lines_are_made_after_the_shuffle(spark, tmp_path, monkeypatch):
    kind = type(spark.range(1))
    whole, seen = kind.repartitionById, []
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: seen.append(self.columns) or whole(self, *a))
    df = spark.createDataFrame([("q1", 0, "c", 5, 0), ("q2", 16, "c", 3, 0), ("q3", 16, None, 9, 2)], "qname string, flag int, rname string, pos bigint, pid int")
    sorted_reads.write_sorted(df, f"file://{tmp_path}/out", 3)
    assert seen == [df.columns]
    assert (tmp_path / "out/part-00000").read_text() == "q2\t16\tc\t3\nq1\t0\tc\t5\n" and (tmp_path / "out/part-00002").read_text() == "q3\t16\t*\t9\n"


def test_ranges_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(views, "SHARE", 200)
    whole, seen = queries.partition.lay_out_by_range, []
    monkeypatch.setattr(queries.partition, "lay_out_by_range", lambda df, n, *by: seen.append(n) or whole(df, n, *by))
    n = views.table(spark, DATA, "lineitem").count()
    assert [tuple(r) for r in queries.reads_in_ranges(spark, DATA).collect()] == [(n, 0, 0)]
    assert seen == [-(-n // 200)]


def test_keys_of_many_reads_have_many_tasks(spark, monkeypatch):
    few = views.keys(spark, DATA)
    monkeypatch.setattr(views, "SHARE", 100)
    many = views.keys(spark, DATA)
    assert many.rdd.getNumPartitions() == views.shares(spark, DATA) > 4 >= few.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_stride_counts_need_no_marks(spark, tmp_path, monkeypatch):
    """A stride's plan rests on its reads alone, not on a second join with the key table."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-00000").write_text("k1 a@r1 0 c 5\nk1 a@r2 0 c 7\n")
    whole, seen = strides.contig_counts, []
    monkeypatch.setattr(strides, "contig_counts", lambda df, *a: seen.append(df.columns) or whole(df, *a))
    keys = spark.createDataFrame([("r1", "k1"), ("r2", "k1")], "qname string, dedup_key string")
    done = strides.mark_in_strides(spark, [[f"file://{tmp_path}/in/part-00000"]], keys, f"file://{tmp_path}/out", 2)
    assert [tuple(r) for r in done.collect()] == [(0, 2, 1)] and len(seen) == 1 and "is_dup" not in seen[0]


def test_given_dictionary_is_made_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text(f"kXXQQr{k}\t0\tc\t{k}\n")
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        made.add(1)
        yield from batches

    contigs = spark.createDataFrame([("c", 1)], "rname string, idx int").coalesce(1).mapInPandas(one, "rname string, idx int")
    streams.run_regions(streams.frame_stream(spark, f"{tmp_path}/in", 1), contigs, f"file://{tmp_path}/out", f"file://{tmp_path}/at", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out/stream-*/reads").count() == 3
    assert made.value == 1


def test_batches_are_not_held(spark, tmp_path, monkeypatch):
    """The manifest comes from what was written."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.txt").write_text("@SQ\tSN:c\nkXXQQr1\t0\tc\t3XXQQr2\t0\t*\t4\n")
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: 1 / 0)
    streams.run_regions(streams.frame_stream(spark, f"{tmp_path}/in"), None, f"file://{tmp_path}/out", f"file://{tmp_path}/at", 4)
    got = spark.read.parquet(f"file://{tmp_path}/out/stream-00000/manifest").orderBy("part").collect()
    assert sum(r["n_reads"] for r in got) == 2 and {c for r in got for c in r["rnames"].split(",")} == {"c", "unmapped"}
