"""Streams of read frames: ``keyXXQQreadXXQQread``, header lines, and a line that ends the stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.sam import parse_read
from lodestar.operators.partition import assign_regions, lay_out, manifest
from lodestar.sinks.reads import read_lines_of
from lodestar.storage import settle
from lodestar.streaming.state import FrozenDictionary, keep_totals, running_totals

MARK = "XXQQ"
END = "##"


def frame_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Frames (value) as they arrive in a folder of text files."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kind():
    """Of a line: header, end, blank or frame."""
    v = F.col("value")
    return F.when(v.startswith("@"), "header").when(v.startswith(END), "end").when(F.trim(v) == "", "blank").otherwise("frame")


def frames(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.split("value", "\n")).alias("value")).where(kind() == "frame")


def reads_of_frames(lines: DataFrame, layout: str = "sam") -> DataFrame:
    """(dedup_key, qname, flag, rname, pos, others) of each read of each frame; reads with too few fields are left out."""
    f = F.split("value", MARK)
    rows = frames(lines).select(F.get(f, F.lit(0)).alias("key"), F.explode(F.slice(f, 2, F.greatest(F.size(f), F.lit(1)))).alias("line"))
    rows = rows.select("key", parse_read(F.col("line"), layout).alias("r")).where("r is not null")
    return rows.select(F.col("key").alias("dedup_key"), "r.qname", "r.flag", "r.rname", "r.pos", "r.others")


def header_of(batch: DataFrame) -> DataFrame:
    """(value, at) of the header lines of a micro-batch."""
    own = batch.select(F.explode(F.split("value", "\n")).alias("value")).where(kind() == "header")
    return own.select("value", F.monotonically_increasing_id().alias("at"))


def region_batches(contigs: DataFrame | None, out: str, partitions: int = 16, seen: list | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: parses, keys by region, lays out and writes reads and manifest of a micro-batch, in folders named by
    its number. A batch that is run again overwrites its own. Without ``contigs``, the stream's header lines make the
    dictionary until its first reads freeze it. ``seen`` gets the number of a batch that holds the line that ends the stream."""

    contigs = None if contigs is None else settle(contigs, "contigs")  # made once, not in each batch

    def write(batch: DataFrame, number: int) -> None:
        if seen is not None and ended(batch):
            seen.append(number)
        dictionary = FrozenDictionary(batch.sparkSession, f"{out}/dictionary")
        known = dictionary.at(number, header_of(batch), lambda: not frames(batch).isEmpty()) if contigs is None else contigs
        assigned = assign_regions(reads_of_frames(batch), known, partitions)
        where = f"{out}/stream-{number:05d}"
        lay_out(assigned, partitions).select("pid", "region_key", "rname", read_lines_of(assigned).alias("value")).write.mode("overwrite").parquet(f"{where}/reads")
        written = batch.sparkSession.read.schema("pid int, rname string").parquet(f"{where}/reads")
        manifest(written).write.mode("overwrite").parquet(f"{where}/manifest")

    return write


def run_regions(lines: DataFrame, contigs: DataFrame | None, out: str, checkpoint: str, partitions: int = 16, interval: str | None = None, wait: float = 0.2) -> None:
    """Take all that is there, then stop; or with an ``interval``, such as 5 seconds, a micro-batch every so often until a
    line ends the stream."""
    seen: list[int] = []
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    query = lines.writeStream.foreachBatch(region_batches(contigs, out, partitions, seen)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    while interval and query.isActive and not seen:
        time.sleep(wait)
    if interval and query.isActive:
        query.processAllAvailable()  # the batch with the line is whole
        query.stop()
    query.awaitTermination()


def count_frames(lines: DataFrame, out: str, checkpoint: str) -> None:
    """(key: null, n, total) of each micro-batch: its frames, and all up to it."""
    keep_totals(running_totals(frames(lines)), out, checkpoint)


def ended(lines: DataFrame) -> bool:
    """Whether a batch holds the line that ends the stream."""
    return not lines.where(kind() == "end").isEmpty()
