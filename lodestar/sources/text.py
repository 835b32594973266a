"""Readers of the text formats. Each gives a DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.sam import BAD_POS, fields, is_header, parse_read


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file) of text files, globs or lists of them."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def file_number(file):
    """The N of a name such as OutputN.ext, by which files are ordered."""
    return F.regexp_extract(F.element_at(F.split(file, "/"), -1), r"^\D*(\d+)", 1).try_cast("int")


def batch_number(file, stride: int, first: int = 0):
    """Which stride of files a file belongs to, by its number."""
    return F.floor((file_number(file) - first) / F.lit(stride))


def read_reads(spark: SparkSession, paths, layout: str = "sam", bad_pos: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads (dedup_key, qname, flag, rname, pos, others, file), and the lines (value, file) that are too short for one.
    Header lines are in neither."""
    lines = read_lines(spark, paths).where(~is_header(F.col("value")) & (F.trim("value") != ""))
    parsed = lines.withColumn("r", parse_read(F.col("value"), layout, BAD_POS[layout] if bad_pos is None else bad_pos))
    return parsed.where("r is not null").select("r.*", "file"), parsed.where("r is null").select("value", "file")


def read_header(spark: SparkSession, paths) -> DataFrame:
    """Header lines (value, at). ``at`` grows along each file: where the line's split of the file begins, and its place in
    what a task reads, which is in the order of the file. Reads, in the same file or not, are passed over line by line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("n"))
    return lines.where(is_header(F.col("value"))).select("value", F.struct("begin", "n").alias("at"))


def read_keys(spark: SparkSession, paths, columns: int = 2) -> DataFrame:
    """(qname, dedup_key), with un1 and un2 for four columns, or (dedup_key) of whole lines for one."""
    if columns == 1:
        return spark.read.text(paths).select(F.col("value").alias("dedup_key"))
    schema = "qname string, dedup_key string" + (", un1 int, un2 int" if columns == 4 else "")
    return spark.read.csv(paths, sep="\t", schema=schema, quote="")


def read_contig_counts(spark: SparkSession, paths) -> DataFrame:
    return spark.read.csv(paths, sep="\t", schema="rname string, n bigint", quote="").select("rname", "n", F.col("_metadata.file_path").alias("file"))


def read_manifest(spark: SparkSession, paths) -> DataFrame:
    """(part, rnames: array) of part.info files; blank lines are none."""
    rows = spark.read.text(paths).where(F.trim("value") != "").select(F.split("value", "\t").alias("f"), F.col("_metadata.file_path").alias("file"))
    return rows.select(F.get("f", F.lit(0)).alias("part"), F.split(F.get("f", F.lit(1)), ",").alias("rnames"), "file")


def read_fai(spark: SparkSession, paths) -> DataFrame:
    rows = spark.read.text(paths).where(F.trim("value") != "").select(fields(F.col("value")).alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("rname"), F.get("f", F.lit(1)).cast("bigint").alias("length"))


def read_vectors(spark: SparkSession, paths, dimension: int = 128) -> DataFrame:
    """(features, label): the first numbers and the last token of each line."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(paths).where(F.trim("value") != "").select(F.slice(f, 1, dimension).cast("array<int>").alias("features"), F.element_at(f, -1).alias("label"))


def read_query_vectors(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").cast("array<int>").alias("features"))


def list_files(spark: SparkSession, paths, pattern: str | None = None) -> DataFrame:
    """(path, name, length) of files, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def merged_contig(name):
    """The contig of a file named number-contig.merged; a contig may hold dashes."""
    return F.regexp_extract(name, r"^\d+-(.*)\.merged$", 1)


def bam_contig(name):
    return F.regexp_extract(name, r"^(.*)\.bam$", 1)
