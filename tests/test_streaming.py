"""Streams give what a batch over the same lines gives."""

import os
import socket
import struct
import threading
import time

import pytest

from lodestar.operators.partition import assign_regions
from lodestar.sinks import reads as sinks
from lodestar.streaming import frames, state
from lodestar.streaming.tcp import GREETING, BlockReader, ReceivedLines, Receivers, Store, receive

LINES = ["@SQ\tSN:c", "1XXQQr1\t99\tc\t100000000\tx XXQQr1 147 c 7", "", "2XXQQr2 0 d 5", "2XXQQshort 0", "##end"]


def test_frames(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES))
    contigs = spark.createDataFrame([("c", 3)], "rname string, idx int")
    lines = spark.read.text(f"{tmp_path}/in")
    batch = assign_regions(frames.reads_of_frames(lines), contigs, 16)
    assert rows(batch, "dedup_key", "qname", "pos", "region_key", "pid") == [("1", "r1", 100000000, 3001, 9), ("1", "r1", 7, 3000, 8), ("2", "r2", 5, 0, 0)]
    assert frames.ended(lines)
    frames.run_regions(frames.frame_stream(spark, f"{tmp_path}/in"), contigs, f"{tmp_path}/out", f"{tmp_path}/offsets")
    got = spark.read.parquet(f"{tmp_path}/out/stream-00000/reads")
    assert rows(got, "region_key", "pid") == [(0, 0), (3000, 8), (3001, 9)]
    frames.count_frames(frames.frame_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/n", f"{tmp_path}/offsets2")
    assert spark.read.parquet(f"{tmp_path}/n/*").first()["n"] == 3


def test_sinks(spark, tmp_path):
    rows = [("a", 0, "c", 5, 1), ("b", 0, "c", 3, 1), ("d", 0, "*", 0, 0)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos bigint, pid int")
    sinks.write_reads(df, f"{tmp_path}/reads", 3, ["@SQ\tSN:c"])
    files = sorted(p.read_text() for p in (tmp_path / "reads").glob("part-*") if p.stat().st_size)
    assert files == ["@SQ\tSN:c\nb\t0\tc\t3\na\t0\tc\t5\n", "@SQ\tSN:c\nd\t0\t*\t0\n"]
    sinks.write_manifest(df, f"{tmp_path}/info")
    assert "".join(p.read_text() for p in sorted((tmp_path / "info").glob("part-*"))) == "part-00000\tunmapped\npart-00001\tc\n"
    sinks.write_by(df, f"{tmp_path}/by", "rname")
    assert spark.read.csv(f"{tmp_path}/by").count() == 3


class Server:
    """Sends each connection its own lines, the last without an end; remembers greetings."""

    def __init__(self, *sent):
        self.sock, self.sent, self.greetings = socket.create_server(("127.0.0.1", 0)), list(sent), []
        self.port = self.sock.getsockname()[1]
        threading.Thread(target=self.serve, daemon=True).start()

    def serve(self):
        for data in self.sent:
            conn, _ = self.sock.accept()
            self.greetings.append(struct.unpack("<i", conn.recv(4))[0])
            conn.sendall(data)
            conn.close()


def received(spark, folder, out, checkpoint, **options):
    spark.dataSource.register(ReceivedLines)
    stream = spark.readStream.format("received_lines").options(**options).load(folder)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(r["value"] for r in spark.read.parquet(out).collect())


def test_receivers_on_executors(spark, tmp_path):
    first, second = Server(b"a1\na2\na3\na4\na5", b"a6\n"), Server(b"b1\nb\xc3\xa9\n")
    folder = f"file://{tmp_path}/blocks"
    job = Receivers(spark, [("127.0.0.1", first.port), ("127.0.0.1", second.port)], folder, rows=2, wait=0.2).start()
    for _ in range(100):
        reader = BlockReader({"path": folder})
        if sum(len(b) for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p)) == 8:
            break
        time.sleep(0.2)
    stored = job.stop()
    assert sorted((r["server"], r["lines"]) for r in stored) == [(0, 6), (1, 2)]
    assert set(first.greetings + second.greetings) == {GREETING}
    lines = [*(f"a{k}" for k in range(1, 7)), "b1", "bé"]
    assert received(spark, folder, f"{tmp_path}/out", f"{tmp_path}/offsets", blocks="1") == lines
    assert received(spark, folder, f"{tmp_path}/out", f"{tmp_path}/offsets") == lines  # nothing is read twice


def test_offsets_come_after_blocks(tmp_path, monkeypatch):
    """What is promised can be read again, and a receiver that died is followed by one that numbers on."""
    folder = f"{tmp_path}/blocks"
    server = Server(b"1\n2\n3\n4\n5\n6\n", b"7\n8\n")
    whole = Store.flush

    def dies(self):
        whole(self)
        raise KeyboardInterrupt  # the task is killed after a block

    monkeypatch.setattr(Store, "flush", dies)
    with pytest.raises(KeyboardInterrupt):
        receive(0, "127.0.0.1", server.port, folder, 4, 0.2, False)
    monkeypatch.undo()
    reader = BlockReader({"path": folder, "blocks": "2"})
    before = reader.latestOffset()
    first = reader.partitions({}, before)
    take = lambda parts: [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
    seen = take(first)
    assert receive(0, "127.0.0.1", server.port, folder, 1, 0.2, False)[1] == 2
    after = reader.latestOffset()
    assert seen == ["1", "2", "3", "4", "5", "6"] and take(first) == seen and take(reader.partitions(before, after)) == ["7", "8"]
    (tmp_path / "blocks" / "server=00000" / "000000000099.part").write_text("half a block")
    assert reader.latestOffset() == after
    BlockReader({"path": folder, "drop": "true"}).commit(after)
    assert reader.latestOffset() == after and len(list((tmp_path / "blocks").glob("*/*.lines"))) == 1


def test_totals_go_on_from_the_checkpoint(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    reads = lambda: frames.reads_of_frames(frames.frame_stream(spark, f"{tmp_path}/in", files_per_batch=1))
    for k, text in enumerate(("1XXQQr1 0 c 5XXQQr2 0 d 5", "2XXQQr3 0 c 5", "3XXQQr4 0 c 5XXQQr5 0 * 5")):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
        state.keep_totals(state.running_totals(reads(), "rname"), f"{tmp_path}/out", f"{tmp_path}/offsets")  # a new query each time
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got, "batch", "key", "n", "total") == [(0, "c", 1, 1), (0, "d", 1, 1), (1, "c", 1, 2), (2, "*", 1, 1), (2, "c", 1, 3)]
    assert rows(state.last_totals(spark, f"{tmp_path}/out"), "key", "total") == [("*", 1), ("c", 3), ("d", 1)]
    (tmp_path / "out" / "batch=00000").rename(tmp_path / "gone")  # earlier output is not needed
    (tmp_path / "in" / "9.txt").write_text("4XXQQr6 0 d 1")
    state.keep_totals(state.running_totals(reads(), "rname"), f"{tmp_path}/out", f"{tmp_path}/offsets")
    assert rows(state.last_totals(spark, f"{tmp_path}/out"), "key", "total") == [("*", 1), ("c", 3), ("d", 2)]


def test_dictionary_is_frozen_by_reads(spark, tmp_path, rows):
    make = lambda *names: spark.createDataFrame([(f"@SQ\tSN:{x}", k) for k, x in enumerate(names)] + [("@HD", 9)], "value string, at long")
    d = state.FrozenDictionary(spark, f"{tmp_path}/d")
    yes, no = lambda: True, lambda: False
    assert rows(d.at(0, make("b"), no)) == [("*", 0), ("b", 1)]
    assert rows(d.at(1, make("b", "a"), no)) == [("*", 0), ("a", 2), ("b", 1)]
    for _ in range(2):  # a batch that is run again
        assert rows(d.at(2, make("c", "*"), yes)) == [("*", 0), ("a", 2), ("b", 1), ("c", 3)]
    assert rows(state.FrozenDictionary(spark, f"{tmp_path}/d").at(3, make("e"), lambda: 1 / 0)) == [("*", 0), ("a", 2), ("b", 1), ("c", 3)]
    assert len(list((tmp_path / "d").iterdir())) == 3


def test_header_end_and_totals(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    for k, lines in enumerate((LINES[:3], ["@SQ\tSN:d", *LINES[3:5]], ["##end"])):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.txt", (1_700_000_000 + k,) * 2)  # streams take the oldest first
    stream = lambda: frames.frame_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    frames.run_regions(stream(), None, f"{tmp_path}/out", f"{tmp_path}/offsets", interval="100 milliseconds")
    got = spark.read.parquet(f"{tmp_path}/out/stream-*/reads")
    assert rows(got, "region_key", "pid") == [(0, 0), (1000, 8), (1001, 9)]  # the header of d comes after the first reads
    frames.count_frames(stream(), f"{tmp_path}/n", f"{tmp_path}/offsets2")
    assert rows(spark.read.parquet(f"{tmp_path}/n"), "batch", "n", "total") == [(0, 1, 1), (1, 2, 3), (2, 0, 3)]


def test_state_stores_do_not_grow_with_tasks(spark, tmp_path):
    """A stream of totals has few state stores however many tasks the session's shuffles have, also as it starts again; totals are those of all lines."""
    (tmp_path / "in").mkdir()
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        for k in range(2):
            (tmp_path / "in" / f"{k}.txt").write_text("".join(f"1XXQQr{i} 0 c{i % 3} 5\n" for i in range(10 + k)))
            lines = frames.frame_stream(spark, f"{tmp_path}/in")
            state.keep_totals(state.running_totals(frames.reads_of_frames(lines), "rname"), f"{tmp_path}/out", f"{tmp_path}/offsets")
            assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    stores = [p for p in (tmp_path / "offsets" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == state.STORES
    assert {r["key"]: r["total"] for r in state.last_totals(spark, f"{tmp_path}/out").collect()} == {"c0": 8, "c1": 7, "c2": 6}
