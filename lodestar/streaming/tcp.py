"""Lines of TCP servers that expect a four-byte greeting: receivers on executors, and a stream over what they have stored.

A receiver is a task of a job of its own, one for each server. It stores lines in blocks, files of the shared folder that get their
names when they are whole, and numbers them on. The stream's offsets count whole blocks: a line is in the shared folder before any
batch is promised it, so that a batch that is run again, on whatever executor, reads the same lines. Neither lines nor blocks
pass through the driver. A receiver that is killed and retried connects again and numbers on after the blocks that are there; what it had
received and not stored yet (``wait`` seconds or ``rows`` lines at most) is lost, as the protocol cannot ask for it again.
"""

from __future__ import annotations

import socket
import struct
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestar.storage import opened

#: The greeting, little-endian; a fixed value of the protocol.
GREETING = 1004
BLOCK, STOP = ".lines", "stop"


def _names(fs: pafs.FileSystem, where: str) -> list[str]:
    return [f.base_name for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))]


def whole_blocks(fs: pafs.FileSystem, where: str) -> int:
    """How many blocks a server's folder has had: one more than the last one's number."""
    return max((int(n.removesuffix(BLOCK)) + 1 for n in _names(fs, where) if n.endswith(BLOCK)), default=0)


class Store:
    """Blocks of one server's lines."""

    def __init__(self, folder: str, server: int):
        self.fs, base = opened(folder)
        self.where, self.base = f"{base}/server={server:05d}", base
        self.fs.create_dir(self.where, recursive=True)
        self.number, self.lines, self.stored = whole_blocks(self.fs, self.where), [], 0

    def flush(self) -> None:
        if not self.lines:
            return
        name = f"{self.where}/{self.number:012d}"
        with self.fs.open_output_stream(name + ".part") as f:
            f.write(b"\n".join(self.lines) + b"\n")
        self.fs.move(name + ".part", name + BLOCK)
        self.number, self.stored, self.lines = self.number + 1, self.stored + len(self.lines), []

    def stopped(self) -> bool:
        return self.fs.get_file_info(f"{self.base}/{STOP}").type != pafs.FileType.NotFound


def receive(server: int, host: str, port: int, folder: str, rows: int, wait: float, again: bool) -> tuple[int, int]:
    """Store a server's lines until it is told to stop, or at the end of the connection unless ``again`` asks for a new one.
    Returns (blocks there, lines stored)."""
    store = Store(folder, server)
    while not store.stopped():
        try:
            with socket.create_connection((host, port), timeout=max(wait, 1.0)) as conn:
                conn.sendall(struct.pack("<i", GREETING))
                conn.settimeout(wait)
                rest, data = b"", b"-"
                while data != b"" and not store.stopped():
                    try:
                        data = conn.recv(1 << 16)
                    except TimeoutError:
                        data = None
                    *whole, rest = (rest + (data or b"")).split(b"\n")
                    store.lines += whole
                    if len(store.lines) >= rows or not data:
                        store.flush()
                store.lines += [rest] if rest else []
        except OSError:
            pass  # try again
        store.flush()
        if not again:
            break
        time.sleep(wait)
    return store.number, store.stored


class Receivers:
    """Receiver tasks, one for each of ``servers`` (host, port), which store blocks in ``folder`` until they are stopped."""

    def __init__(self, spark: SparkSession, servers: list[tuple[str, int]], folder: str, rows: int = 10_000, wait: float = 0.5, again: bool = True):
        self.spark, self.servers, self.folder, self.rows, self.wait, self.again = spark, list(servers), folder, rows, wait, again
        self.result: list | None = None
        self.thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> Receivers:
        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        servers, folder, rows, wait, again = self.servers, self.folder, self.rows, self.wait, self.again

        def run(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    blocks, lines = receive(k, *servers[k], folder, rows, wait, again)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blocks]), pa.array([lines])], names=["server", "blocks", "lines"])

        n = len(servers)
        self.result = self.spark.range(0, n, 1, n).mapInArrow(run, "server long, blocks long, lines long").collect()

    def stop(self) -> list:
        """(server, blocks, lines) once all have stored what they had."""
        fs, base = opened(self.folder)
        with fs.open_output_stream(f"{base}/{STOP}") as f:
            f.write(b"")
        self.thread.join()
        return self.result


@dataclass
class Blocks(InputPartition):
    """Blocks ``first`` to ``end`` of a server's folder."""

    server: str
    first: int
    end: int


class BlockReader(DataSourceStreamReader):
    """Offsets are numbers of whole blocks by server folder. A batch has a partition for every ``blocks`` blocks of a server."""

    def __init__(self, options: dict):
        self.folder, self.blocks = options["path"], int(options.get("blocks", "16"))
        self.drop = options.get("drop", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, base = opened(self.folder)
        return {name: whole_blocks(fs, f"{base}/{name}") for name in sorted(_names(fs, base)) if name.startswith("server=")}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return [Blocks(s, k, min(k + self.blocks, n)) for s, n in sorted(end.items()) for k in range(start.get(s, 0), n, self.blocks)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.folder)
        for k in range(partition.first, partition.end):
            with fs.open_input_stream(f"{base}/{partition.server}/{k:012d}{BLOCK}") as f:
                lines = f.read().decode("utf-8", "replace").split("\n")[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    def commit(self, end: dict) -> None:
        """With the option ``drop``, blocks that no batch will read again go."""
        fs, base = opened(self.folder)
        for s, n in end.items() if self.drop else ():
            for name in _names(fs, f"{base}/{s}"):
                if name.endswith(BLOCK) and int(name.removesuffix(BLOCK)) < n - 1:  # the last one tells the number to go on from
                    fs.delete_file(f"{base}/{s}/{name}")


class ReceivedLines(DataSource):
    """``spark.readStream.format("received_lines").load(folder)``, once registered: (value) of the receivers' blocks."""

    @classmethod
    def name(cls) -> str:
        return "received_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))
