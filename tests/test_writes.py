"""Writes that give counts and manifests with them, and runs that go on where they were stopped."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestar.operators import dedup, graph, staged, strides
from lodestar.sinks.sorted_reads import SortedReadsWriter, write_sorted

READS = "qname string, dedup_key string, flag int, rname string, pos bigint, pid int"


def files(path):
    return {p.name: p.read_text() for p in path.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_manifest_comes_with_the_write(spark, tmp_path):
    rows = [("a", "k", 0, "c", 5, 1), ("b", "k", 0, "d", 3, 1), ("d", "k", 0, "*", 0, 0), ("e", "k", 0, None, 9, 2)]
    path = tmp_path / "out"
    df = spark.createDataFrame(rows, READS)
    write_sorted(df, f"file://{path}", 4, ["@HD"])
    assert files(path) == {"_SUCCESS": "", "part.info": "part-00000\tunmapped\npart-00001\tc,d\npart-00002\tunmapped\n", "part-00000": "@HD\nd\t0\t*\t0\n", "part-00001": "@HD\nb\t0\td\t3\na\t0\tc\t5\n", "part-00002": "@HD\ne\t0\t*\t9\n"}
    with pytest.raises(Exception, match="FileExistsError"):
        write_sorted(df, str(path), 4)
    write_sorted(df.where("pid = 0"), str(path), 4, mode="overwrite")
    assert files(path) == {"_SUCCESS": "", "part.info": "part-00000\tunmapped\n", "part-00000": "d\t0\t*\t0\n"}
    write_sorted(df.limit(0), f"{tmp_path}/none", 4)
    assert files(tmp_path / "none") == {"_SUCCESS": "", "part.info": ""}


def test_attempts_that_fail_leave_no_file(tmp_path):
    batch = lambda *pids: pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(["c"] * len(pids)), pa.array([f"l{p}" for p in pids])], names=["pid", "rname", "value"])
    writer = SortedReadsWriter({"path": f"{tmp_path}/w", "header": json.dumps(["@"])}, False)
    lost = writer.write(iter([batch(0, 0, 1)]))  # a task whose message never arrives
    again = writer.write(iter([batch(0), batch(0, 1)]))
    assert [(f[0], f[3]) for f in lost.files] == [(f[0], f[3]) for f in again.files] == [(0, 2), (1, 1)]
    other = writer.write(iter([batch(1)]))
    with pytest.raises(ValueError, match="two partitions"):
        writer.commit([again, other])
    assert list((tmp_path / "w").iterdir()) == []
    writer.commit([None, writer.write(iter([batch(0, 0, 1)]))])
    assert files(tmp_path / "w") == {"_SUCCESS": "", "part.info": "part-00000\tc\npart-00001\tc\n", "part-00000": "@\nl0\nl0\n", "part-00001": "@\nl1\n"}


def test_counts_are_observed(spark, tmp_path):
    reads = spark.createDataFrame([("a", "k", 0, "c", 1, 0), ("b", "k", 0, "c", 2, 0), ("d", "x", 0, "c", 4, 0)], READS)
    marked, seen = dedup.mark_representative_kept(reads, reads.select("qname", "dedup_key")), Observation("n")
    dedup.observed(marked, seen).write.parquet(f"{tmp_path}/m")
    assert seen.get == dedup.counts(marked).first().asDict() == {"total_reads": 3, "marked_reads": 1}
    empty = Observation("none")
    dedup.observed(marked.where("false"), empty).write.parquet(f"{tmp_path}/n")
    assert set(empty.get.values()) <= {0, None} or empty.get == {}


def test_strides_go_on(spark, tmp_path, rows, monkeypatch):
    (tmp_path / "in").mkdir()
    keys = []
    for k in (0, 2, 10, 11, 3):
        lines = [f"k{j % 4} lane@q{k}_{j}\t0\tc{j % 3}\t{j}" for j in range(6)]
        (tmp_path / "in" / f"Output{k}.sbl").write_text("@HD\n" + "\n".join(lines) + "\n")
        keys += [(f"q{k}_{j}", f"k{j % 4}") for j in range(6)]
    keys = spark.createDataFrame(keys, "qname string, dedup_key string")
    groups = strides.strides_of(spark, f"{tmp_path}/in", 2, "*.sbl")
    assert [[p.rsplit("/", 1)[1] for p in g] for g in groups] == [["Output0.sbl", "Output2.sbl"], ["Output3.sbl", "Output10.sbl"], ["Output11.sbl"]]
    out = f"file://{tmp_path}/out"
    assert rows(strides.mark_in_strides(spark, groups, keys, out, 4, ["@SQ\tSN:c0"], most=1), "loop", "n_reads", "n_marked") == [(0, 12, 8)]
    stamp = (tmp_path / "out" / "loop000" / "part.info").stat().st_mtime_ns
    wrote = []
    whole = strides.write_sorted

    def stopped(df, path, *a, **b):
        whole(df, path, *a, **b)
        wrote.append(path[-3:])
        if len(wrote) == 1:
            raise KeyboardInterrupt  # after the stride's files, before its counts

    monkeypatch.setattr(strides, "write_sorted", stopped)
    with pytest.raises(KeyboardInterrupt):
        strides.mark_in_strides(spark, groups, keys, out, 4)
    got = strides.mark_in_strides(spark, groups, keys, out, 4)
    assert wrote == ["001", "001", "002"]  # the one under way is done again, the one before is not
    assert rows(got, "loop", "n_reads", "n_marked") == [(0, 12, 8), (1, 12, 12), (2, 6, 6)]
    assert (tmp_path / "out" / "loop000" / "part.info").stat().st_mtime_ns == stamp
    assert "@SQ\tSN:c0\n" in (tmp_path / "out" / "loop000" / "part-00001").read_text()
    assert strides.mark_in_strides(spark, [], keys, f"file://{tmp_path}/other", 4).count() == 0


def test_stages_and_markers(spark, tmp_path, rows):
    made = tmp_path / "made"
    made.mkdir()
    plan = spark.createDataFrame([(1, f"cp {made}/a.bai {made}/b"), (0, f"cp /dev/null {made}/a.bai"), (0, "true"), (0, "true")], "stage int, command string")
    log = f"{tmp_path}/log"
    assert rows(staged.run(plan, log, 2), "stage", "code") == [(0, 0), (0, 0), (1, 0)]
    assert (made / "b").exists() and rows(staged.finished(spark, log)) == sorted({(r["command"],) for r in plan.collect()})
    (made / "b").unlink()
    assert rows(staged.run(plan, log, 2), "stage", "code") == [(0, 0), (0, 0), (1, 0)]
    assert not (made / "b").exists()  # it was finished before
    bad = spark.createDataFrame([(0, "false"), (0, "no-such-program-here"), (0, f"touch {made}/c"), (1, f"touch {made}/d")], "stage int, command string")
    assert sorted(map(str, (r["code"] for r in staged.run(bad, log, 2).collect()))) == ["0", "1", "127", "None"]
    assert (made / "c").exists() and not (made / "d").exists()
    assert staged.run(bad.limit(0), log).count() == 0


def test_index_if_missing(spark, rows):
    make = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(staged.missing_indexes(make("a.bam", "b.bam", "b.bam"), make("a.bam.bai", "c.bam.bai"))) == [("b.bam",)]
    calls = spark.createDataFrame([("a.bam", "call 1"), ("b.bam", "call 2"), ("b.bam", "call 3")], "path string, command string")
    got = staged.plan(make("a.bam", "b.bam", "unused.bam"), make("a.bam.bai"), calls)
    assert rows(got) == [(0, "samtools index b.bam"), (1, "call 1"), (1, "call 2"), (1, "call 3")]


def test_routes_double(spark, rows, monkeypatch):
    """A way of 20 hops in five rounds."""
    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(20)] + [(0, 20, 100)], "src int, dst int, w int")
    rounds = []
    whole = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name, *a: (rounds.append(name), whole(df, name, *a))[1])
    got = graph.routes(edges, graph.shortest_paths(edges))
    assert rows(got.where("src = 0 and dst = 20"), "dist", "hops", "route") == [(20, 20, ">".join(map(str, range(21))))]
    assert rounds.count("routes") == 6 and got.count() == 210
    assert got.where(F.col("hops") != F.col("dst") - F.col("src")).count() == 0
