"""Tiling of contigs into regions, and the jobs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Options of the variant caller, fixed values.
CALLER = "--pooled-discrete --pooled-continuous --min-alternate-fraction 0.1 --genotype-qualities --report-genotype-likelihood-max --allele-balance-priors-off"


def tiles(contigs: DataFrame, size: int) -> DataFrame:
    """(idx, name, start, end): each contig cut at multiples of ``size``, numbered over all contigs by name. A contig's
    first number is a sum over the contigs before it, so that tiles are made where their contig is."""
    whole = contigs.where("length > 0").select(F.col("rname").alias("name"), "length", F.ceil(F.col("length") / size).alias("n"))
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    based = whole.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = based.select("name", "length", "base", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("k", "start"))
    return cut.select((F.col("base") + F.col("k")).cast("bigint").alias("idx"), "name", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def with_files(tiled: DataFrame, files: DataFrame) -> DataFrame:
    """Tiles with each file (path, rname) of their contig."""
    return tiled.join(files, F.col("name") == F.col("rname")).drop("rname")


def by_file(pairs: DataFrame) -> DataFrame:
    """(path, n_regions, regions): name:start-end of each file's tiles, by number."""
    listed = F.sort_array(F.collect_list(F.struct("idx", F.format_string("%s:%d-%d", "name", "start", "end").alias("r"))))
    by = pairs.groupBy("path").agg(F.count("*").alias("n_regions"), listed.alias("l"))
    return by.select("path", "n_regions", F.array_join(F.transform("l", lambda x: x["r"]), "\n").alias("regions"))


def by_region(pairs: DataFrame) -> DataFrame:
    """(idx, name, start, end, files): each tile's files in order."""
    return pairs.groupBy("idx", "name", "start", "end").agg(F.array_join(F.sort_array(F.collect_set("path")), " ").alias("files"))


def bundles(tiled: DataFrame, lines: int) -> DataFrame:
    """(bundle, n_regions, regions): ``lines`` tiles of consecutive numbers in each."""
    listed = F.sort_array(F.collect_list(F.struct("idx", F.format_string("%s:%d-%d", "name", "start", "end").alias("r"))))
    by = tiled.groupBy(F.floor(F.col("idx") / lines).alias("b")).agg(F.count("*").alias("n_regions"), listed.alias("l"))
    return by.select(F.format_string("region%02d.txt", "b").alias("bundle"), "n_regions", F.array_join(F.transform("l", lambda x: x["r"]), "\n").alias("regions"))


def commands(pairs: DataFrame, out: str, reference: str, caller: str = "freebayes", slices: int = 10) -> DataFrame:
    """(idx, path, vcf, command): the call of each tile and file. The slice of a job is its tile's number modulo ``slices``."""
    vcf = F.format_string(f"{out}/%06d.%010d.%s.%013d-%013d.vcf", "idx", F.pmod("idx", F.lit(slices)), "name", "start", "end")
    command = F.concat(F.lit(f"{caller} -v "), "vcf", F.lit(f" {CALLER} -f {reference} "), "path", F.format_string(" -r %s:%d-%d", "name", "start", "end"))
    return pairs.withColumn("vcf", vcf).select("idx", "path", "vcf", command.alias("command"))
