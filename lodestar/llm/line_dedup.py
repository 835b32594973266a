"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. A key of at least ``min_chars`` code
points that is held by two or more documents keeps its lines in the smallest doc_id that holds it and loses all others.

Batches of documents in ascending doc_id order go one by one against the runs: tables of (128-bit key hash, first
doc_id), each bucketed and sorted by hash, all with the same buckets. A batch's keys become such a table too and are
merge-anti-joined with the runs bucket by bucket, with neither shuffle nor sort; what is new to them is a run of its own
at level 0, and a level that holds ``fanout`` runs is merged into one run of the next level. So each key is rewritten
about log(batches) times, and no batch ever compares lines with lines. A batch loses the lines of all its keys that are
not new, and of new keys those beyond the first document. Batches have ``batch_lines`` lines or so for each bucket, a quarter
of all at most; lines are written once more by batch, so that each batch reads its own folder only. All tables of a job go when
it ends, be it by failure.

The merge joins need Spark to take the tables' order as given, which is a setting: they run in a session of their own,
and the caller's settings stay as they are.

Only DataFrame operations; hashes and positions are shuffled, and the texts once, by doc_id.

Defined cases. Null text: one empty line. Rows that share a doc_id are one document; a null doc_id is one document after
all others. Extra columns are ignored by ``line_drops`` and kept by
``without_repeats`` whatever their names; ``dedup_lines`` adds ``_lines``, ``_drop`` and ``_kept`` to them. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.packed import REST, pack, unpack
from lodestar.llm.ranges import range_of
from lodestar.llm.text import lower_ascii, strip_white
from lodestar.storage import new_path, remove, settle

LAST = 9223372036854775807
LINE = "_did long, _row long, pos int, h1 long, h2 long"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(df: DataFrame) -> list[Column]:
    """The document, and what tells rows of one doc_id apart; equal rows share it and get equal results."""
    return [F.coalesce("doc_id", F.lit(LAST)).alias("_did"), F.xxhash64("text").alias("_row")]


def hash_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(_did, _row, pos, h1, h2) of each line whose key is long enough to count."""
    lines = docs.select(*_row_key(docs), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("_did", "_row", "pos", strip_white(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    keys = keys.select("_did", "_row", "pos", lower_ascii(F.col("line")).alias("key"))
    return keys.select("_did", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


class HashTables:
    """Tables bucketed and sorted by (h1, h2) in the shared folder, and a session that relies on their order."""

    def __init__(self, spark: SparkSession):
        own = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
            if (value := spark.conf.get(key, None)) is not None and own.conf.isModifiable(key):
                own.conf.set(key, value)
        # a table's order counts only if asked for, and each of its buckets is one file
        own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark, self.names = own, {}
        self.buckets = int(own.conf.get("spark.sql.shuffle.partitions"))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` by bucket, so that each is written by one task, as one file."""
        return df.repartition(self.buckets, "h1", "h2")

    def write(self, df: DataFrame, kind: str) -> str:
        """The name of a table of rows that lie by bucket, as those read from such tables do."""
        path = new_path(self.spark, kind)
        name = "lodestar_" + path.rsplit("/", 1)[-1].replace("-", "_")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name, format="parquet")
        self.names[name] = path
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.names.pop(name))

    def drop_all(self) -> None:
        for name in list(self.names):
            self.drop(name)


class LineRuns:
    """The runs (h1, h2, first) by level."""

    def __init__(self, tables: HashTables, fanout: int = 2):
        self.tables, self.fanout, self.levels = tables, fanout, []

    def new_of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, a table like the runs, whose hash no run holds."""
        for run in (r for level in self.levels for r in level):
            keys = keys.join(self.tables.read(run).hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, run: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            olds, self.levels[level] = self.levels[level], []
            merged = self.tables.read(olds[0]).select("h1", "h2", "first")
            for old in olds[1:]:  # no key is in two runs
                other = self.tables.read(old).select("h1", "h2", F.col("first").alias("second"))
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("first", "second").alias("first"))
            self.add(self.tables.write(merged, f"run{level + 1}"), level + 1)
            for old in olds:
                self.tables.drop(old)

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                self.tables.drop(run)
        self.levels = []


def lines_by_batch(lines: DataFrame, n_batches: int, path: str) -> tuple[DataFrame, int]:
    """``lines`` written anew with one folder for each batch, ``_batch`` from 0 in ascending order of _did, and the number of batches.

    A batch is made of ranges of _did of about equal numbers of lines, so that one task writes each range into one folder."""
    spark = lines.sparkSession
    per_batch = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_batches)
    n = per_batch * n_batches
    cuts = lines.select(F.percentile_approx("_did", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [] if n > 1 else []
    # ranges that a document fills alone leave fewer cuts than asked for; batches count the ranges that there are
    cuts = sorted(set(cuts))
    ranged = lines.withColumn("_range", range_of(F.col("_did"), cuts).cast("int"))
    dealt = ranged.repartitionById(len(cuts) + 1, "_range").select("*", F.expr(f"_range div {per_batch}").cast("int").alias("_batch")).drop("_range")
    dealt.write.partitionBy("_batch").parquet(path)
    return spark.read.schema(f"{LINE}, _batch int").parquet(path), len(cuts) // per_batch + 1


def line_drops(docs: DataFrame, min_chars: int = 10, batch_lines: int = 2_000_000, fanout: int = 2, least_batches: int = 4) -> DataFrame:
    """(_did, _row, drop: ascending line positions to drop) of the rows that lose lines."""
    spark, tables = docs.sparkSession, HashTables(docs.sparkSession)
    lines_path, drop_path, parts = new_path(spark, "lines"), new_path(spark, "drops"), []
    try:
        plain = settle(hash_lines(docs.select("doc_id", "text"), min_chars), "lines", f"{lines_path}/plain")
        n_batches = max(least_batches, -(-plain.count() // (batch_lines * tables.buckets)))
        lines, n_batches = lines_by_batch(tables.spark.read.schema(LINE).parquet(f"{lines_path}/plain"), n_batches, f"{lines_path}/batches")
        remove(spark, f"{lines_path}/plain")
        runs = LineRuns(tables, fanout)
        for k in range(n_batches):
            parts.append(new_path(spark, "lost"))
            run = _lost_of_batch(tables, runs, lines.where(F.col("_batch") == k), parts[-1])
            if k < n_batches - 1:  # else no batch follows
                runs.add(run)
        # equal rows carry equal positions, so a set of positions is the whole answer
        lost = spark.read.schema("_did long, _row long, pos int").parquet(*parts)
        return settle(lost.groupBy("_did", "_row").agg(F.array_sort(F.collect_set("pos")).alias("drop")), "drops", drop_path)
    finally:
        tables.drop_all()
        for p in [lines_path, *parts]:
            remove(spark, p)


def _lost_of_batch(tables: HashTables, runs: LineRuns, batch: DataFrame, path: str) -> str:
    """Write the lines that a batch loses to ``path``; the name of the table of its keys that no run holds."""
    keys = tables.write(tables.dealt(batch.groupBy("h1", "h2").agg(F.min("_did").alias("first"), F.max("_did").alias("last"))), "keys")
    run = tables.write(runs.new_of(tables.read(keys)), "run0")
    new = tables.read(run)
    again = tables.read(keys).join(new.hint("merge"), ["h1", "h2"], "left_anti")
    lose = again.select("h1", "h2", F.lit(None).cast("long").alias("first")).unionAll(new.where(F.col("last") > F.col("first")).select("h1", "h2", "first"))
    met = batch.join(lose, ["h1", "h2"]).where(F.col("first").isNull() | (F.col("_did") > F.col("first")))
    settle(met.select("_did", "_row", "pos"), "lost", path)
    tables.drop(keys)
    return run


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``_lines`` (all lines), ``_drop`` (positions dropped) and ``_kept`` (the text that stays)."""
    drops = line_drops(docs, **options)
    keyed = docs.select("*", *_row_key(docs))
    out = keyed.join(drops, ["_did", "_row"], "left").drop("_did", "_row")
    out = out.withColumn("_lines", split_lines(F.col("text"))).withColumn("_drop", F.coalesce("drop", F.array().cast("array<int>"))).drop("drop")
    # one flag for each line up to the last dropped one, made of the gaps between positions: linear in the lines
    gaps = F.zip_with("_drop", F.concat(F.array(F.lit(-1)), F.col("_drop")), lambda p, before: F.concat(F.array_repeat(F.lit(False), F.greatest(F.coalesce(p, before) - before - 1, F.lit(0))), F.when(p.isNull(), F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True)))))
    kept = F.array_join(F.zip_with("_lines", F.flatten(gaps), lambda line, gone: F.when(gone, F.lit(None)).otherwise(line)), "\n")
    return out.withColumn("_kept", F.when(F.size("_drop") == 0, F.coalesce("text", F.lit(""))).otherwise(kept))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) of the lines that stay. All rows and columns stay."""
    out = dedup_lines(pack(docs, "doc_id", "text"), **options).select("doc_id", "text", REST, "_kept")
    changed = {"text": F.col("_kept")} | ({"n_chars": F.char_length("_kept").cast("long")} if "n_chars" in docs.columns else {})
    return unpack(out.drop("text"), docs.columns, **changed)


def op10(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))
