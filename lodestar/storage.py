"""Tables shared by the driver and all executors, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one is set only where none is named and
    the whole of Spark is one process, as in tests. Elsewhere a folder of this machine would lose tables: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isEmpty():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        there = sc._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: what follows no longer depends on its lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """``df`` as a written table, to be broadcast if it has ``most`` rows at most, which is counted first."""
    table = settle(df, name)
    return F.broadcast(table) if table.count() <= most else table


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows that the driver has, as part of the plan: reading it takes no job of its own."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in kind]
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], names=kind.names), kind)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole (written to their end) Spark tables in a folder; none if it is not there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system, of those that pyarrow opens, of a path or address, and the path in it: for tasks that write files of their own."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
