"""What a stream remembers: running totals in a state store, and a dictionary that its first reads freeze."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestar.functions.sam import UNMAPPED
from lodestar.operators.contigs import header_names
from lodestar.storage import children, local


#: State stores of a stream of totals: what reaches them was counted before, a row for each key and Arrow batch.
STORES = 8


def running_totals(rows: DataFrame, by: str | None = None) -> DataFrame:
    """(key, n, total) of a stream: in each micro-batch, the rows of each key in it, and all up to it. ``by`` is the column of the keys; without
    it there is one key, null, which has a row in each batch that has any input, even where none is counted.

    Totals are in a state store, so that a batch reads no earlier one, and a query that starts again from its checkpoint goes on
    from them. Tasks count their own rows first: a frequent key costs the shuffle a row for each Arrow batch.
    """

    def count(batches):
        total = 0
        for b in batches:
            if by is None:
                total += b.num_rows
            elif b.num_rows:
                found = pc.value_counts(b.column(0))
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["key", "n"])
        if by is None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([total])], names=["key", "n"])

    def add(key, batches, state):
        n = sum(int(b["n"].sum()) for b in batches)
        total = n + (state.get[0] if state.exists else 0)
        state.update((total,))
        yield pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "n": [n], "total": [total]})

    key = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    counted = rows.select(key.alias("key")).mapInArrow(count, "key string, n long")
    return counted.groupBy("key").applyInPandasWithState(add, "key string, n long, total long", "total long", "update", GroupStateTimeout.NoTimeout)


def keep_totals(totals: DataFrame, out: str, checkpoint: str, stores: int = STORES) -> None:
    """Take all that is there: the totals of each micro-batch go to a folder of their own, which a repeated batch overwrites.

    A stream's first start fixes its number of state stores, ``stores``, or as many as the session's shuffles have tasks, if these are fewer.
    Each batch has a task for every store, however few keys it holds.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.repartition(1).write.mode("overwrite").parquet(f"{out}/batch={number:05d}")  # by coalesce, one task would go over all stores

    conf = totals.sparkSession.conf
    tasks = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", min(stores, int(tasks)))
    try:  # a query takes the session's settings as it starts
        query = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", tasks)
    query.awaitTermination()


def last_totals(spark: SparkSession, out: str) -> DataFrame:
    """(key, total) as of the last batch that met each key."""
    rows = spark.read.schema("key string, n bigint, total bigint, batch int").parquet(out)
    return rows.groupBy("key").agg(F.max("total").alias("total"))


class FrozenDictionary:
    """The contig dictionary of a stream: header lines add to it until the first batch with reads, which freezes it.

    A version (rname, idx, frozen) is written for each batch that changes it, named by the batch's number; a batch reads the latest version
    before its own, never earlier batches. A batch that is run again, or a query that starts again, comes to the same.
    """

    KIND = "rname string, idx int, frozen boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, number: int) -> DataFrame | None:
        versions = [n for n in (int(v.removeprefix("v=")) for v in children(self.spark, self.path) if v.startswith("v=")) if n < number]
        return self.spark.read.schema(self.KIND).parquet(f"{self.path}/v={max(versions):06d}") if versions else None

    def at(self, number: int, header: DataFrame, has_reads: Callable[[], bool]) -> DataFrame:
        """(rname, idx) for a batch with header lines (value, at); ``has_reads`` tells if the batch has reads, asked only while open."""
        known = self.before(number)
        if known is not None and known.first()["frozen"]:
            return known.select("rname", "idx")
        starts = has_reads()
        known = local(self.spark, [(UNMAPPED, 0)], "rname string, idx int") if known is None else known.select("rname", "idx")
        fresh = header_names(header).join(known.select("rname"), "rname", "left_anti")
        most = known.agg(F.max("idx")).first()[0]
        fresh = fresh.select("rname", (F.row_number().over(Window.orderBy("at", "rname")) + most).alias("idx"))
        path = f"{self.path}/v={number:06d}"
        known.unionByName(fresh).withColumn("frozen", F.lit(starts)).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.KIND).parquet(path).select("rname", "idx")
