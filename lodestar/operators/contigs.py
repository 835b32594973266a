"""The contig dictionary and the header lines that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.sam import UNMAPPED


def header_names(header: DataFrame) -> DataFrame:
    """(rname, at): each contig of the @SQ lines, as first seen."""
    return header.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"SN:(\S+)", 1).alias("rname"), "at").groupBy("rname").agg(F.min("at").alias("at"))


def dictionary_of_header(header: DataFrame) -> DataFrame:
    """(rname, idx) from header lines (value, at): the unmapped contig is 0, others count from 1 as first seen."""
    dense = header_names(header).where(F.col("rname") != UNMAPPED).select("rname", F.row_number().over(Window.orderBy("at", "rname")).alias("idx"))
    return dense.unionByName(header.sparkSession.createDataFrame([(UNMAPPED, 0)], "rname string, idx int"))


def kept_header(header: DataFrame) -> DataFrame:
    """(value, at): the first line of each @SQ contig and the first @RG line; no others."""
    sq = header.where(F.col("value").startswith("@SQ")).groupBy(F.regexp_extract("value", r"SN:(\S+)", 1).alias("k"))
    rg = header.where(F.col("value").startswith("@RG")).groupBy(F.lit("@RG").alias("k"))
    first = F.min(F.struct("at", "value")).alias("m")
    return sq.agg(first).unionByName(rg.agg(first)).select("m.value", "m.at")


def dictionary_of_reads(reads: DataFrame) -> DataFrame:
    """(rname, idx, length) of the contigs that reads are on: by name from 1, unmapped 0, one past the largest position."""
    by = reads.groupBy("rname").agg((F.max("pos") + 1).alias("length"))
    dense = by.where(F.col("rname") != UNMAPPED).select("rname", F.row_number().over(Window.orderBy("rname")).alias("idx"), "length")
    return dense.unionByName(reads.sparkSession.createDataFrame([(UNMAPPED, 0, 0)], "rname string, idx int, length bigint"))
