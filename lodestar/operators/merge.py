"""Plans of two-level merges of sorted part files. Commands are planned, not run (see ``runner``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.sam import UNMAPPED

FAN_IN = 5


def files_by_contig(parts: DataFrame) -> DataFrame:
    """(rname, n_files, files: array in order) from (path, rname) rows."""
    by = parts.select("path", "rname").distinct().groupBy("rname").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return by.select("rname", F.size("files").alias("n_files"), "files")


def contigs_by_part(parts: DataFrame) -> DataFrame:
    """(path, rnames: array in order) of files with more than one contig."""
    by = parts.groupBy("path").agg(F.sort_array(F.collect_set("rname")).alias("rnames"))
    return by.where(F.size("rnames") > 1)


def chunks(items: Column, size: int = FAN_IN) -> Column:
    """An array cut into arrays of ``size``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.transform(starts, lambda i: F.slice(items, i * size + 1, size))


def level_one(by_contig: DataFrame, directory: str, tool: str = "samtools", threads: int = 4, fmt: str = "bam", size: int = FAN_IN) -> DataFrame:
    """(file_idx, rname, n_files, target, command): one merge of up to ``size`` files each, numbered over all contigs."""
    cut = by_contig.select("rname", F.posexplode(chunks(F.col("files"), size)).alias("chunk", "files"))
    cut = cut.withColumn("file_idx", F.row_number().over(Window.orderBy("rname", "chunk")) - 1)
    target = F.format_string(f"{directory}/%06d-%s.merged", "file_idx", "rname")
    command = F.concat(F.lit(f"{tool} merge -@ {threads} -c -p -O {fmt} "), "target", F.lit(" "), F.array_join("files", " "))
    return cut.withColumn("target", target).select("file_idx", "rname", F.size("files").alias("n_files"), "target", command.alias("command"))


def alternating(sizes: DataFrame) -> DataFrame:
    """(part, bytes, seq): by turns the largest and the smallest of what is left, ties by name."""
    n = F.count("*").over(Window.partitionBy())
    down = F.row_number().over(Window.orderBy(F.col("bytes").desc(), "part"))
    ranked = sizes.select("part", "bytes", down.alias("rd"), n.alias("n"))
    up = F.col("n") + 1 - F.col("rd")
    big = F.col("rd") <= F.ceil(F.col("n") / 2)
    return ranked.select("part", "bytes", F.when(big, 2 * F.col("rd") - 2).otherwise(2 * up - 1).cast("int").alias("seq"))


def part_commands(parts: DataFrame, schedule: DataFrame, directory: str, tool: str = "samtools", threads: int = 4, fmt: str = "bam", size: int = FAN_IN) -> DataFrame:
    """(seq, part, loop, command) over same-named files: chunked if there are more than ``size``, in the schedule's order.
    ``parts`` has (part, path, rname); the least contig names the output."""
    by = parts.groupBy("part").agg(F.sort_array(F.collect_set("path")).alias("files"), F.min("rname").alias("rname"))
    cut = by.select("part", "rname", F.size("files").alias("n"), F.posexplode(chunks(F.col("files"), size)).alias("k", "files"))
    number = F.when(F.col("n") > size, (F.col("k") + 1).cast("string")).otherwise("")
    command = F.concat(F.lit(f"{tool} merge -@ {threads} -O {fmt} {directory}/"), "part", number, F.lit("-"), "rname", F.lit(".merged "), F.array_join("files", " "))
    return cut.join(schedule.select("part", "seq"), "part").select("seq", "part", (F.col("k") + 1).alias("loop"), command.alias("command"))


def level_two(merged: DataFrame, directory: str, tool: str = "samtools", fmt: str = "bam") -> DataFrame:
    """(out_idx, rname, action, n_files, command) from (rname, target): contigs of several files are merged, in name order,
    then those of one are moved, the unmapped contig last."""
    by = merged.groupBy("rname").agg(F.sort_array(F.collect_list("target")).alias("files"))
    merge = F.size("files") > 1
    order = Window.orderBy(F.when(merge, 0).otherwise(1), F.when(~merge & (F.col("rname") == UNMAPPED), 1).otherwise(0), "rname")
    out = by.withColumn("out_idx", F.row_number().over(order) - 1).withColumn("action", F.when(merge, "merge").otherwise("move"))
    target = F.concat(F.lit(f"{directory}/Output"), "out_idx", F.lit(f".{fmt}"))
    files = F.array_join("files", " ")
    command = F.when(merge, F.concat(F.lit(f"{tool} merge -c -p -O {fmt} "), target, F.lit(" "), files)).otherwise(F.concat(F.lit("mv "), files, F.lit(" "), target))
    return out.select("out_idx", "rname", "action", F.size("files").alias("n_files"), command.alias("command"))
