"""Duplicate marking of many read files, a stride of files at a time, that goes on where it was stopped.

The global key table is made once and kept. Files are taken in the order of their numbers. Each stride is parsed, marked against
the whole key table, planned by its own contig counts and written, sorted and with header and manifest, to a folder of its own; its counts come
with that write. They are written last, and a stride that has them is done: starting again skips it, and does again
the one that was under way. Strides are in turn because each asks for the cluster's disks once; within one, all is distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import dedup, partition
from lodestar.operators.profile import contig_counts
from lodestar.sinks.sorted_reads import write_sorted
from lodestar.sources.text import file_number, list_files, read_reads
from lodestar.storage import children, local, settle


def strides_of(spark: SparkSession, paths: str, stride: int, pattern: str | None = None) -> list[list[str]]:
    """Files by the number in their names, ``stride`` in each list. Only names come to the driver."""
    files = list_files(spark, paths, pattern).select("path", file_number(F.col("name")).alias("n")).where("n is not null")
    names = [r["path"] for r in files.orderBy("n", "path").collect()]
    return [names[k : k + stride] for k in range(0, len(names), stride)]


def mark_in_strides(spark: SparkSession, strides: list[list[str]], keys: DataFrame, out: str, partitions: int, header: list[str] | None = None, layout: str = "keyed", most: int | None = None) -> DataFrame:
    """(loop, n_reads, n_marked) of all strides done so far, of which at most ``most`` are done in this call. Output is in ``out``/loopNNN."""
    if "duplicates" not in children(spark, f"{out}/tables"):
        dedup.duplicate_keys(keys).select("dedup_key", "rep_qname").write.mode("overwrite").parquet(f"{out}/tables/duplicates")
    duplicates = spark.read.parquet(f"{out}/tables/duplicates")
    done = set(children(spark, f"{out}/counts"))
    todo = [k for k in range(len(strides)) if f"loop={k:03d}" not in done]
    for k in todo[:most]:
        reads = read_reads(spark, strides[k], layout)[0]
        marked = dedup.mark_against(reads, duplicates)
        seen = Observation(f"loop {k}")
        counted = dedup.observed(marked, seen)
        planned = partition.plan(contig_counts(reads), partitions)
        table = settle(planned, "plan", f"{out}/plans/loop={k:03d}") if f"loop={k:03d}" not in children(spark, f"{out}/plans") else spark.read.parquet(f"{out}/plans/loop={k:03d}")
        n = partition.total_partitions(table, partitions)
        write_sorted(partition.assign(counted, table), f"{out}/loop{k:03d}", n, header, mode="overwrite")
        got = seen.get
        local(spark, [(k, got["total_reads"], got["marked_reads"])], "loop int, n_reads long, n_marked long").coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/loop={k:03d}")
    names = [f"{out}/counts/{c}" for c in children(spark, f"{out}/counts")]
    kind = "loop int, n_reads bigint, n_marked bigint"
    return spark.read.schema(kind).parquet(*names) if names else local(spark, [], kind)
