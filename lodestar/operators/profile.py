"""Counts by key, contig and qname."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contig_counts(reads: DataFrame, *by: str) -> DataFrame:
    return reads.groupBy(*by, "rname").agg(F.count("*").alias("n"))


def rollup_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("rname").agg(F.sum("n").alias("n"))


def key_multiplicity(lines: DataFrame, min_count: int = 3) -> DataFrame:
    """(dedup_key, n_extra) of whole-line keys that occur ``min_count`` times or more."""
    return lines.groupBy("dedup_key").agg((F.count("*") - 1).alias("n_extra")).where(F.col("n_extra") >= min_count - 1)


def excess(keys: DataFrame) -> DataFrame:
    """Rows beyond the first of each key, in all: one row."""
    return keys.groupBy("dedup_key").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("excess"))


def qnames_by_batch(reads: DataFrame, batch: str = "batch") -> DataFrame:
    return reads.groupBy(batch).agg(F.countDistinct("qname").alias("n_qnames"))
