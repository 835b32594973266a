"""Commands in stages, each run once: indexes that are missing first, then what needs them.

A command that ended well leaves a marker, a file of the shared folder named by the command's digest. Tasks write it themselves, right
after the command, so that a task that is retried, or a run that is started again, passes over what is finished. A stage begins when all
of the one before it ended well; else later stages are left, with null codes.
"""

from __future__ import annotations

import hashlib
import shlex
import subprocess

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import new_path, opened, settle


def missing_indexes(files: DataFrame, indexes: DataFrame, suffix: str = ".bai") -> DataFrame:
    """(path) of ``files`` (path) for which ``indexes`` (path) lists no file of that name and ``suffix``."""
    there = indexes.select(F.col("path").alias("_index")).distinct()
    return files.select("path").distinct().join(there, F.concat("path", F.lit(suffix)) == F.col("_index"), "left_anti")


def plan(files: DataFrame, indexes: DataFrame, calls: DataFrame, indexer: str = "samtools index", suffix: str = ".bai") -> DataFrame:
    """(stage, command): stage 0 indexes the files of ``calls`` (path, command) that have no index, stage 1 calls."""
    index = missing_indexes(files.join(calls.select("path").distinct(), "path", "left_semi"), indexes, suffix)
    first = index.select(F.lit(0).alias("stage"), F.concat(F.lit(f"{indexer} "), "path").alias("command"))
    return first.unionByName(calls.select(F.lit(1).alias("stage"), "command"))


def _marker(command: str) -> str:
    return f"{hashlib.sha256(command.encode()).hexdigest()}.done"


def finished(spark, log: str) -> DataFrame:
    """(command) of those that have ended well."""
    fs, base = opened(log)
    fs.create_dir(base, recursive=True)
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.done").schema("value string").text(log).select(F.col("value").alias("command"))


def run(planned: DataFrame, log: str, slices: int = 10) -> DataFrame:
    """(stage, command, code) of a plan (stage, command), run stage by stage; 0 for what was finished before, null for what a failure
    kept from starting. Commands run without a shell, 127 if one cannot be started. ``log`` is a shared folder that pyarrow opens."""
    spark = planned.sparkSession

    def start(command: str, fs: pafs.FileSystem, base: str) -> int:
        name = f"{base}/{_marker(command)}"
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            return 0  # an earlier attempt of this task
        try:
            code = subprocess.run(shlex.split(command), check=False).returncode
        except OSError:
            return 127
        if code == 0:
            with fs.open_output_stream(name + ".part") as f:
                f.write(command.encode())
            fs.move(name + ".part", name)
        return code

    def go(batches):
        fs, base = opened(log)
        for b in batches:
            codes = [start(c, fs, base) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.int32())], names=["stage", "command", "code"])

    whole = settle(planned.select("stage", "command").distinct(), "commands")
    out, well = [], True
    for stage in [r["stage"] for r in whole.select("stage").distinct().orderBy("stage").collect()]:
        mine = whole.where(F.col("stage") == stage)
        if not well:
            out.append(mine.withColumn("code", F.lit(None).cast("int")))
            continue
        past = finished(spark, log).distinct()
        todo = mine.join(past, "command", "left_anti").select("stage", "command").repartition(slices).mapInArrow(go, "stage int, command string, code int")
        before = mine.join(past, "command", "left_semi").select("stage", "command", F.lit(0).alias("code"))
        ended = settle(before.unionByName(todo), "codes", new_path(spark, "codes"))
        well = ended.where("code <> 0").isEmpty()
        out.append(ended)
    if not out:
        return whole.withColumn("code", F.lit(None).cast("int"))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done
