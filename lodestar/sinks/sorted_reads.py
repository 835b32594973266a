"""A writer of laid-out reads that makes the manifest in the same pass.

``df.write.format("sorted_reads")`` takes (pid, rname, value) laid out by pid. A task writes one text file for each pid that it has, after the
lines of option ``header`` (a JSON array); its commit message names the contigs and counts the lines of each file. The commit gives the
files their names, part-<pid>, and writes ``part.info`` from the messages, a line ``part-<pid> TAB contigs`` for each, and ``_SUCCESS``
last. Until then files lie in a folder of the attempt: what a task leaves that failed has no name in the result. A task holds one
batch of lines and the names of one file's contigs.

A table that is there already is replaced in mode overwrite and is an error otherwise. Two partitions with lines of one pid are an error.
The path is one that pyarrow opens, on storage that the driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestar.functions.sam import UNMAPPED
from lodestar.operators.partition import ORDER
from lodestar.sinks.reads import read_lines_of
from lodestar.storage import opened

#: The manifest's name for the contig of reads that are on none; a fixed value of the format.
SHOWN = "unmapped"


@dataclass
class Written(WriterCommitMessage):
    """(pid, file, contigs, lines) of what one task wrote."""

    files: list[tuple[int, str, list[str], int]] = field(default_factory=list)


class SortedReadsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], json.loads(options.get("header", "[]")), overwrite
        self.attempt = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.path)
        fs.create_dir(f"{base}/{self.attempt}", recursive=True)
        out, now, names, n, f = Written(), None, set(), 0, None

        def close():
            if f is not None:
                f.close()
                out.files.append((now, path, sorted(names), n))

        for b in iterator:
            b = b.filter(pc.is_valid(b.column("value")))
            pids = b.column("pid").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), len(pids)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if first == end:
                    continue
                if pids[first] != now:
                    close()
                    now, names, n = int(pids[first]), set(), 0
                    path = f"{self.attempt}/{now:05d}-{uuid.uuid4().hex}"
                    f = fs.open_output_stream(f"{base}/{path}")
                    f.write("".join(x + "\n" for x in self.header).encode())
                some = b.slice(first, end - first)
                f.write(("\n".join(some.column("value").to_pylist()) + "\n").encode())
                names.update(SHOWN if x == UNMAPPED else x for x in pc.unique(some.column("rname")).to_pylist())
                n += end - first
        close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.path)
        if fs.get_file_info(f"{base}/_SUCCESS").type != pafs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        if len({f[0] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("lines of one pid are in two partitions")
        for info in fs.get_file_info(pafs.FileSelector(base)):
            if info.is_file:
                fs.delete_file(info.path)
        for pid, file, _, _ in files:
            fs.move(f"{base}/{file}", f"{base}/part-{pid:05d}")
        with fs.open_output_stream(f"{base}/part.info") as f:
            f.write("".join(f"part-{pid:05d}\t{','.join(names)}\n" for pid, _, names, _ in files).encode())
        fs.delete_dir(f"{base}/{self.attempt}")
        with fs.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.path)
        if fs.get_file_info(f"{base}/{self.attempt}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.attempt}")


class SortedReads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sorted_reads"

    def schema(self) -> str:
        return "pid int, rname string, value string"

    def writer(self, schema, overwrite: bool) -> SortedReadsWriter:
        return SortedReadsWriter(dict(self.options), overwrite)


def write_sorted(assigned: DataFrame, path: str, n: int, header: list[str] | None = None, value=None, mode: str = "append") -> None:
    """Write reads with pid below ``n``, sorted by position, with header and manifest; ``value`` is a line's column if it is not the plain one.
    Reads of no contig, null, are written as unmapped."""
    assigned = assigned.withColumn("rname", F.coalesce("rname", F.lit(UNMAPPED)))
    assigned.sparkSession.dataSource.register(SortedReads)
    laid = assigned.repartitionById(n, "pid").sortWithinPartitions("pid", *ORDER)  # fields are shuffled; lines, which repeat them, are made after
    laid = laid.select("pid", "rname", (read_lines_of(assigned) if value is None else value).alias("value"))
    laid.write.format("sorted_reads").option("header", json.dumps(header or [])).mode(mode).save(path)
