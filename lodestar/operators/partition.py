"""Partition plans and layouts for output files.

The contig-proportional plan gives each contig as many partitions as its share of the reads asks for, one at least; a
read goes to one of its contig's by position modulo their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.sam import region_key, shown_contig
from lodestar.storage import sized

ORDER = ["pos", "rname", "qname", "flag"]


def plan(counts: DataFrame, partitions: int) -> DataFrame:
    """(rname, n, parts, acc) for ``counts`` (rname, n): partitions of each contig, and those before it by name."""
    total = F.sum("n").over(Window.partitionBy())  # over one row for each contig
    expected = F.greatest(F.lit(1), F.floor(F.floor(total / partitions) * F.lit(11) / 10))
    parts = F.greatest(F.lit(1), F.floor(F.col("n") / expected)).cast("bigint")
    before = Window.orderBy("rname").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("rname", "n", parts.alias("parts")).withColumn("acc", F.coalesce(F.sum("parts").over(before), F.lit(0)))


def total_partitions(planned: DataFrame, partitions: int) -> int:
    return max(partitions, planned.agg(F.sum("parts")).first()[0] or 0)


def assign(reads: DataFrame, planned: DataFrame) -> DataFrame:
    """``reads`` with pid by plan; a contig that is not planned goes to 1."""
    small = sized(planned.select("rname", "parts", "acc"), "plan")
    out = reads.join(small, "rname", "left").withColumn("pid", F.coalesce(F.pmod("pos", "parts") + F.col("acc"), F.lit(1)).cast("int"))
    return out.drop("parts", "acc")


def assign_regions(reads: DataFrame, contigs: DataFrame, partitions: int, kind: str = "coarse") -> DataFrame:
    """``reads`` with region_key, and pid by its remainder."""
    keyed = reads.join(sized(contigs.select("rname", "idx"), "contigs"), "rname", "left")
    keyed = keyed.withColumn("region_key", region_key(F.col("idx"), F.col("pos"), kind)).drop("idx")
    return keyed.withColumn("pid", F.pmod("region_key", F.lit(partitions)).cast("int"))


def lay_out(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """Rows in the partition that pid names, sorted by position within it. Sorting spills."""
    return df.repartitionById(n, "pid").sortWithinPartitions(*(order or ORDER))


def lay_out_by_range(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """Rows in sampled ranges of ``by``."""
    return df.repartitionByRange(n, *by).sortWithinPartitions(*ORDER)


def manifest(assigned: DataFrame) -> DataFrame:
    """(part, rnames, n_reads): the contigs in each partition that has rows, in order and joined by commas."""
    by = assigned.groupBy("pid").agg(F.array_join(F.sort_array(F.collect_set(shown_contig(F.col("rname")))), ",").alias("rnames"), F.count("*").alias("n_reads"))
    return by.select(F.format_string("part-%05d", "pid").alias("part"), "rnames", "n_reads")
