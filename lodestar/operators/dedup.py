"""Duplicate keys and duplicate marking.

Keys are (qname, dedup_key) rows; reads have qname, dedup_key, flag, rname, pos. A key is duplicated if ``min_count`` rows or
more share it; its representative is the least qname. Key aggregates add up in each task before they are shuffled. Joins
take the reads by shuffle unless Spark measures the key side as small enough to broadcast; a key or qname that many reads
share is then split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestar.functions.sam import UNMAPPED, mark_duplicate


def mapped_pairs(keys: DataFrame) -> DataFrame:
    """Keys of pairs of which both mates are mapped."""
    return keys.where(F.col("un1") + F.col("un2") == 0)


def duplicate_keys(keys: DataFrame, min_count: int = 2) -> DataFrame:
    """(dedup_key, n_extra, rep_qname) of duplicated keys."""
    by = keys.groupBy("dedup_key").agg((F.count("*") - 1).alias("n_extra"), F.min("qname").alias("rep_qname"))
    return by.where(F.col("n_extra") >= min_count - 1)


def duplicate_members(keys: DataFrame, min_count: int = 2) -> DataFrame:
    """(dedup_key, n_extra, members: array in order) of duplicated keys."""
    by = keys.groupBy("dedup_key").agg((F.count("*") - 1).alias("n_extra"), F.sort_array(F.collect_list("qname")).alias("members"))
    return by.where(F.col("n_extra") >= min_count - 1)


def nonfirst_members(keys: DataFrame) -> DataFrame:
    """(dedup_key, qname) of all but the first qname of each key, by join with the least so that no key is sorted whole."""
    dup = duplicate_keys(keys)
    firsts = keys.join(dup.select("dedup_key", "rep_qname"), "dedup_key")
    copies = firsts.groupBy("dedup_key", "qname", "rep_qname").count()
    again = F.col("count") - F.when(F.col("qname") == F.col("rep_qname"), 1).otherwise(0)
    return copies.select("dedup_key", F.explode(F.array_repeat("qname", again.cast("int"))).alias("qname"))


def _marked(reads: DataFrame, hit: Column, *drop: str) -> DataFrame:
    out = reads.withColumn("is_dup", F.coalesce(hit, F.lit(False)))
    return out.withColumn("flag", F.when(F.col("is_dup"), mark_duplicate(F.col("flag"))).otherwise(F.col("flag"))).drop(*drop)


def mark_representative_kept(reads: DataFrame, keys: DataFrame, min_count: int = 2) -> DataFrame:
    """Marks reads whose key is duplicated, but for those of the key's representative."""
    return mark_against(reads, duplicate_keys(keys, min_count))


def mark_against(reads: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The same by a table (dedup_key, rep_qname) that was made before."""
    dup = duplicates.select("dedup_key", "rep_qname")
    return _marked(reads.join(dup, "dedup_key", "left"), F.col("qname") != F.col("rep_qname"), "rep_qname")


def mark_group_head(reads: DataFrame, keys: DataFrame, batch: str = "batch") -> DataFrame:
    """Marks all reads of a key in a batch if the first of them, by position, is not of the key's representative."""
    dup = duplicate_keys(keys).select("dedup_key", "rep_qname")
    heads = reads.groupBy(batch, "dedup_key").agg(F.min(F.struct("pos", "rname", "qname", "flag")).getField("qname").alias("head"))
    heads = heads.join(dup, "dedup_key").where("head <> rep_qname").select(batch, "dedup_key", F.lit(True).alias("hit"))
    return _marked(reads.join(heads, [batch, "dedup_key"], "left"), F.col("hit"), "hit")


def mark_qnames(reads: DataFrame, qnames: DataFrame, mapped_only: bool = False) -> DataFrame:
    """Marks reads whose qname is in ``qnames`` (qname), and on a contig if ``mapped_only``."""
    hits = qnames.select("qname").distinct().withColumn("hit", F.lit(True))
    hit = F.col("hit") & (F.col("rname") != UNMAPPED) if mapped_only else F.col("hit")
    return _marked(reads.join(hits, "qname", "left"), hit, "hit")


def mark_all_mapped(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks the reads of every qname in any duplicated key of mapped pairs; ``keys`` has un1 and un2."""
    good = mapped_pairs(keys)
    dup = duplicate_keys(good).select("dedup_key")
    return mark_qnames(reads, good.join(dup, "dedup_key", "left_semi"))


def mark_representatives(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks the reads of representatives only, if they are mapped."""
    return mark_qnames(reads, duplicate_keys(keys).select(F.col("rep_qname").alias("qname")), mapped_only=True)


def mark_tagged(reads: DataFrame, keys: DataFrame, min_count: int = 3) -> DataFrame:
    """Marks reads whose key is in ``min_count`` rows of ``keys`` or more."""
    dup = duplicate_keys(keys, min_count).select("dedup_key", F.lit(True).alias("hit"))
    return _marked(reads.join(dup, "dedup_key", "left"), F.col("hit"), "hit")


def mark_multiread(reads: DataFrame) -> DataFrame:
    """Marks reads whose qname has two reads or more."""
    many = reads.groupBy("qname").count().where("count > 1")
    return mark_qnames(reads, many)


def observed(marked: DataFrame, seen: Observation) -> DataFrame:
    """``marked``, whose first run also gives ``seen`` its total_reads and marked_reads: no run of its own counts them."""
    return marked.observe(seen, F.count(F.lit(1)).alias("total_reads"), F.count_if("is_dup").alias("marked_reads"))


def counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("total_reads"), F.count_if("is_dup").alias("marked_reads"))


def group_reads(reads: DataFrame, by: str = "qname") -> DataFrame:
    """(by, n_reads, reads: array of (flag, rname, pos) in order)."""
    return reads.groupBy(by).agg(F.count("*").alias("n_reads"), F.sort_array(F.collect_list(F.struct("flag", "rname", "pos"))).alias("reads"))


def window_nonfirst(keys: DataFrame) -> DataFrame:
    """As ``nonfirst_members``, by a window: one sort of each key's rows."""
    order = Window.partitionBy("dedup_key").orderBy("qname")
    return keys.withColumn("k", F.row_number().over(order)).where("k > 1").drop("k")
