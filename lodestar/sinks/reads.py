"""Writers of laid-out reads, manifests and key tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.sam import read_line
from lodestar.operators.partition import lay_out, manifest
from lodestar.operators.profile import contig_counts


def read_lines_of(reads: DataFrame):
    others = F.col("others") if "others" in reads.columns else None
    return read_line(F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos"), others)


def write_reads(assigned: DataFrame, path: str, n: int, header: list[str] | None = None) -> None:
    """One text file for each pid that has reads, sorted by position, after the lines of ``header`` if given."""
    out = lay_out(assigned, n).select(read_lines_of(assigned).alias("value"))
    if header:

        def with_header(batches):
            first = True
            for b in batches:
                if first and len(b):
                    yield pd.DataFrame({"value": header})
                    first = False
                yield b

        out = out.mapInPandas(with_header, "value string")
    out.write.text(path)


def write_manifest(assigned: DataFrame, path: str) -> None:
    manifest(assigned).orderBy("part").select(F.concat_ws("\t", "part", "rnames").alias("value")).coalesce(1).write.text(path)


def write_contig_counts(reads: DataFrame, path: str, file: str = "file") -> None:
    """Contig counts of each input file, in a folder of its own."""
    contig_counts(reads, file).write.partitionBy(file).csv(path, sep="\t")


def write_keys(keys: DataFrame, path: str) -> None:
    keys.write.csv(path, sep="\t", quote="")


def write_by(df: DataFrame, path: str, column: str, fmt: str = "csv", **options) -> None:
    """One folder for each value of ``column``. Rows are dealt by the value and a hash, so that a frequent one has
    several writers."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(F.col(column), salt).write.partitionBy(column).format(fmt).options(**options).save(path)
