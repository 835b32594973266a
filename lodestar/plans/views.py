"""Views over the test tables that stand for the inputs of read processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.sam import read_line
from lodestar.operators.contigs import dictionary_of_reads


#: Reads of one task.
SHARE = 1_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(qname, dedup_key, flag, rname, pos, file)."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_orderkey").cast("string").alias("qname"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("dedup_key"),
        (F.col("l_linenumber") * 16).cast("int").alias("flag"),
        F.concat("l_returnflag", "l_linestatus").alias("rname"),
        (F.col("l_partkey").cast("bigint") * 100003 + F.col("l_orderkey").cast("bigint")).alias("pos"),
        F.pmod(F.col("l_suppkey"), F.lit(8)).cast("int").alias("file"),
    )


def plain_reads(spark, d):
    return reads(spark, d).drop("file")


def batched(spark, d, stride: int = 3):
    return reads(spark, d).withColumn("batch", F.floor(F.col("file") / stride).cast("int")).drop("file")


def shares(spark, d, least: int = 1) -> int:
    """How many tasks the reads are dealt to, so that one has ``SHARE`` of them or so; ``least`` at least."""
    return max(least, -(-table(spark, d, "lineitem").count() // SHARE))


def keys(spark, d):
    """(qname, dedup_key), distinct. Of many reads, those of a key go to one of so many tasks as their number calls for, which
    also serves what is grouped by key; else the session's number of tasks does."""
    rows, n = plain_reads(spark, d).select("qname", "dedup_key"), shares(spark, d)
    return (rows.repartition(n, "dedup_key") if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows).distinct()


def keys4(spark, d):
    return keys(spark, d).withColumn("un1", F.when(F.pmod(F.col("qname").cast("bigint"), F.lit(5)) == 0, 1).otherwise(0)).withColumn("un2", F.lit(0))


def contigs(spark, d):
    return dictionary_of_reads(plain_reads(spark, d))


def doc_reads(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("qname"), F.md5(F.col("text").cast("binary")).alias("dedup_key"), F.lit(0).alias("flag"), F.col("lang").alias("rname"), F.col("n_chars").cast("bigint").alias("pos"))


def parts(spark, d):
    """(loop, part, rname, bytes, path): part files of each pass with the contigs that they hold."""
    t = table(spark, d, "lineitem")
    named = t.select(F.col("l_linenumber").cast("int").alias("loop"), F.format_string("part-%05d", F.pmod(F.col("l_suppkey"), F.lit(40)).cast("int")).alias("part"), F.concat("l_returnflag", "l_linestatus").alias("rname"))
    by = named.groupBy("loop", "part", "rname").agg(F.count("*").alias("bytes"))
    return by.withColumn("path", F.concat(F.lit("loop-"), F.col("loop").cast("string"), F.lit("/"), "part"))


def bams(spark, d):
    """(path, rname): one file of each contig in the folder of each pass."""
    t = table(spark, d, "lineitem")
    named = t.select(F.col("l_linenumber").cast("string").alias("loop"), F.concat("l_returnflag", "l_linestatus").alias("rname")).distinct()
    return named.select(F.concat(F.lit("/work/"), "loop", F.lit("/"), "rname", F.lit(".bam")).alias("path"), "rname")


def vectors(spark, d):
    return table(spark, d, "embeddings")


def edges(spark, d):
    o, li, c, s = (table(spark, d, x) for x in ("orders", "lineitem", "customer", "supplier"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    by = j.groupBy(F.col("c_nationkey").cast("int").alias("src"), F.col("s_nationkey").cast("int").alias("dst")).agg(F.count("*").alias("w"))
    return by.where((F.col("src") != F.col("dst")) & (F.pmod(F.col("src") * 7 + F.col("dst"), F.lit(5)) == 0))


def frames(spark, d):
    r = reads(spark, d)
    return r.select(F.concat("dedup_key", F.lit("XXQQ"), read_line(F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos"))).alias("value"))
