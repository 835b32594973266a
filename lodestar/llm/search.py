"""Ranked lexical search by hierarchical max trees over document ranges, searched best first with bounds.

Scores. w = floor(1000 ln((2N+2)/(2df+1))) for a term, m = 25 + (75 n N) div L for a document, and a document's score sums
w ((10^9 tf) div (1000 tf + 8 m)) over a query's terms, repeats included; all but w in integers.

Index. Documents are cut, as they lie, into ranges of ``RANGE`` documents. A range is one row: for each term that any query
holds, the documents of the range that hold it, and how often. Over a range's postings of each term stands a tree of
maxima, ``FAN`` documents to a node, ``FAN`` nodes to the next, up to the range; above the ranges, two tables hold each
term's maximum in a range and in a group (the ranges that one task made).

Search. A node's bound for a query is the sum of its terms' maxima there, and no document below it scores more. First, each
query goes down to the group and the range of the highest bound, and its ``TOP`` th score there is its floor. Then it visits all ranges
whose group and whose own bound reach the floor. Within a range the node of the highest bound is opened next, until the
highest bound is less than the ``TOP`` th score found; a node whose bound equals it is opened, as it may hold a tie of a
smaller doc_id. So results are exact.

On Spark. Texts are read once; ranges are never shuffled in the first search and go to their queries by their number in the
second. Queries' terms are dealt to blocks of some ``TERMS`` distinct terms, so that what tasks are sent is bounded.
A range is closed after ``POSTINGS`` postings, however few documents it has.

Defined cases. Null texts have no terms. Documents without any of the queries' terms count in N, L and are in no range.
Repeated rows are documents of their own, with equal ranks broken arbitrarily among rows that are equal; null doc_ids
come last among equal scores. Queries that are null, empty or of unknown terms only have no results; of a repeated
item_id, each row is a query, and ranks run on over the equal rows. Extra columns are left out. No documents: no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.kept import forget, parts
from lodestar.llm.text import UPPER
from lodestar.storage import new_path, remove, settle

RANGE, FAN, TOP, TERMS, POSTINGS = 4096, 16, 10, 200_000, 2_000_000
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
NO_ID = 2**63 - 1


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER) if text and not text.isascii() else (text or "").lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms each."""
    if len(n) and 75 * int(n.max()) * n_docs >= 2**63:
        return np.array([25 + 75 * int(x) * n_docs // total for x in n], np.int64)
    return 25 + 75 * n.astype(np.int64) * n_docs // max(total, 1)


class Tree:
    """The trees of maxima of one range: level 0 holds postings (term, document), each next level nodes of ``FAN``."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int):
        """Postings are sorted by term, then document."""
        self.names, place = np.unique(term, return_inverse=True)
        self.depth, self.width = 0, max(1, n_docs)
        while FAN**self.depth < self.width:
            self.depth += 1
        self.spans = [FAN ** (self.depth - k) for k in range(self.depth + 1)]  # nodes of a term by level
        self.keys, self.values = [place * self.spans[0] + doc], [value]
        for _ in range(self.depth):
            up = self.keys[-1] // FAN
            first = np.flatnonzero(np.diff(up, prepend=-1))
            self.keys.append(up[first])
            self.values.append(np.maximum.reduceat(self.values[-1], first) if len(first) else self.values[-1])

    def below(self, level: int, node: int, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The summed maxima of the ``FAN`` children of a node, for terms at ``places`` that a query has ``times`` times."""
        keys, values, low = self.keys[level - 1], self.values[level - 1], places * self.spans[level - 1] + node * FAN
        begin, end = np.searchsorted(keys, low), np.searchsorted(keys, low + FAN)
        n = end - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.zeros(FAN, np.int64)
        np.add.at(sums, keys[at] - np.repeat(low, n), values[at] * np.repeat(times, n))
        return sums

    def search(self, names: np.ndarray, times: np.ndarray, ids: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], int]:
        """The ``TOP`` best (score, doc_id, document) with a score of ``least`` or more, smaller doc_ids first among equals; and the
        number of nodes opened."""
        place = np.searchsorted(self.names, names)
        there = place < len(self.names)
        there[there] = self.names[place[there]] == names[there]
        places, times = place[there], times[there]
        best: list[tuple[int, int, int]] = []  # a heap, the worst first
        opened = 0
        if not len(places):
            return best, opened
        heap = [(-int((self.values[-1][places] * times).sum()), self.depth, 0)]
        while heap and -heap[0][0] >= max(least, 1):
            bound, level, node = heapq.heappop(heap)
            if len(best) == TOP and -bound < best[0][0]:
                break
            if level == 0:
                found = (-bound, -int(ids[node]), -node)
                heapq.heappush(best, found) if len(best) < TOP else heapq.heappushpop(best, found)
                continue
            opened += 1
            sums = self.below(level, node, places, times)
            for k in np.flatnonzero(sums >= max(least, 1)).tolist():
                heapq.heappush(heap, (-int(sums[k]), level - 1, node * FAN + k))
        return [(s, -i, -d) for s, i, d in sorted(best, reverse=True)], opened


def _ranges(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """A row for each range: its number and group, its documents and their lengths, and the postings sorted by term; and a row
    without documents for each batch that counts documents and terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        forget()
        known, part, made = sent.value, TaskContext.get().partitionId(), 0
        ids, lengths, held, size, n_docs, total = [], [], [], 0, 0, 0

        def row():
            doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
            term = np.concatenate([np.fromiter(h, np.int32, len(h)) for h in held]) if held else np.zeros(0, np.int32)
            tf = np.concatenate([np.fromiter(h.values(), np.int32, len(h)) for h in held]) if held else np.zeros(0, np.int32)
            order = np.lexsort((doc, term))
            cell = lambda x, kind: pa.array([x], pa.list_(kind))
            columns = [pa.array([part << 32 | made]), pa.array([part], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64()), cell(ids, pa.int64()), cell(lengths, pa.int64())]
            columns += [cell(term[order], pa.int32()), cell(doc[order], pa.int32()), cell(tf[order], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["range", "part", "n_docs", "total", "ids", "lengths", "term", "doc", "tf"])

        for b in parts(batches, 1, 1000):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = Counter(terms(text))
                n = counts.total()
                n_docs, total = n_docs + (n > 0), total + n
                mine = {known[t]: c for t, c in counts.items() if t in known} if len(counts) < len(known) else {known[t]: counts[t] for t in known.keys() & counts.keys()}
                if mine:
                    ids.append(NO_ID if doc_id is None else doc_id)
                    lengths.append(n)
                    held.append(mine)
                    size += len(mine)
                    if len(held) == RANGE or size >= POSTINGS:
                        yield row()
                        ids, lengths, held, size, n_docs, total, made = [], [], [], 0, 0, 0, made + 1
        if held or n_docs:
            yield row()

    kinds = "range long, part long, n_docs long, total long, ids array<long>, lengths array<long>, term array<int>, doc array<int>, tf array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


class Scores:
    """What turns postings into scores: N, L and the terms' weights."""

    def __init__(self, n_docs: int, total: int, weights: np.ndarray):
        self.n_docs, self.total, self.weights = n_docs, total, weights

    def values(self, lengths, term, doc, tf) -> np.ndarray:
        tf = tf.astype(np.int64)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damping(lengths, self.n_docs, self.total)[doc]))


def _row(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """(ids, lengths, term, doc, tf) of a range."""
    return [b.column(b.schema.get_field_index(c)).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "term", "doc", "tf")]


def _maxima(ranges: DataFrame, scores: Scores) -> DataFrame:
    """(group, range, tid, most): each term's greatest value in each range."""
    sent = ranges.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        forget()
        for b in batches:
            for k in range(b.num_rows):
                _, lengths, term, doc, tf = _row(b, k)
                value = sent.value.values(lengths, term, doc, tf)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                n = len(first)
                cell = lambda c: pa.array(np.full(n, b.column(b.schema.get_field_index(c))[k].as_py()), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([cell("part"), cell("range"), pa.array(term[first]), pa.array(np.maximum.reduceat(value, first) if n else value, pa.int64())], names=["part", "range", "tid", "most"])

    return ranges.mapInArrow(run, "part long, range long, tid int, most long")


def _found(ranges: DataFrame, scores: Scores, queries: DataFrame) -> DataFrame:
    """(q, score, doc_id, opened): the best of each range for the queries that visit it. ``ranges`` have a column ``visits``, the
    queries' numbers and floors."""
    spark = ranges.sparkSession
    held = {r["q"]: (np.array(r["tids"], np.int32), np.array(r["times"], np.int64)) for r in queries.toLocalIterator()}
    sent = spark.sparkContext.broadcast((scores, held))

    def run(batches):
        forget()
        how, asked = sent.value
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths, term, doc, tf = _row(b, k)
                tree = Tree(term, doc, how.values(lengths, term, doc, tf), len(ids))
                out = []
                for v in b.column(b.schema.get_field_index("visits"))[k].as_py():
                    best, opened = tree.search(*asked[v["q"]], ids, v["least"])
                    out += [(v["q"], s, None if i == NO_ID else i, opened) for s, i, _ in best]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "score", "doc_id", "opened"])

    return ranges.mapInArrow(run, "q long, score long, doc_id long, opened long")


def _best(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def _visiting(ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ranges that ``pairs`` (q, range, least) name, with their queries."""
    return ranges.join(pairs.groupBy("range").agg(F.collect_list(F.struct("q", "least")).alias("visits")), "range")


def _search_block(spark: SparkSession, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, rank, doc_id, score) for queries (q, terms: an array of structs of term and times), whose distinct terms are bounded."""
    made: list[str] = []

    def table(df, name):
        made.append(new_path(spark, name))
        return settle(df, name, made[-1])

    vocabulary = {r["term"]: k for k, r in enumerate(asked.select(F.explode("terms.term").alias("term")).distinct().orderBy("term").toLocalIterator())}
    number = spark.createDataFrame(list(vocabulary.items()), "term string, tid int")
    long = asked.select("q", F.explode("terms").alias("t")).select("q", "t.term", "t.times").join(number, "term").select("q", "tid", "times")
    queries = table(long.groupBy("q").agg(F.collect_list("tid").alias("tids"), F.collect_list("times").alias("times")), "queries")
    long = queries.select("q", F.explode(F.arrays_zip("tids", "times")).alias("t")).select("q", F.col("t.tids").alias("tid"), F.col("t.times").alias("times"))
    ranges = table(_ranges(docs, vocabulary), "ranges")
    all_docs = ranges.agg(F.sum("n_docs").alias("n"), F.sum("total").alias("l")).first()
    n_docs, total = all_docs["n"] or 0, all_docs["l"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in ranges.select(F.explode("term").alias("tid")).groupBy("tid").count().toLocalIterator():
        df[r["tid"]] = r["count"]
    scores = Scores(n_docs, total, np.array([weight(n_docs, int(x)) for x in df], np.int64))
    ranges = ranges.where(F.size("ids") > 0)
    maxima = table(_maxima(ranges, scores), "maxima")
    summed = lambda df, *at: df.join(F.broadcast(long), "tid").groupBy("q", *at).agg(F.sum(F.col("most") * F.col("times")).alias("bound"))  # noqa: E731  # terms of a block's queries are bounded
    parts_ = table(summed(maxima.groupBy("part", "tid").agg(F.max("most").alias("most")), "part"), "bounds")
    top = parts_.groupBy("q").agg(F.max_by("part", F.struct("bound", "part")).alias("part"))
    first = summed(maxima.join(F.broadcast(top.select(F.col("part").alias("_part")).distinct()), F.col("part") == F.col("_part"), "left_semi"), "part", "range")
    first = first.join(top, ["q", "part"]).groupBy("q").agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    begun = table(_best(_found(_visiting(ranges, first.withColumn("least", F.lit(1).cast("long"))), scores, queries)), "begun")
    floor = begun.where(F.col("rank") == TOP).select("q", F.col("score").alias("least"))
    floors = table(queries.select("q").join(floor, "q", "left").select("q", F.coalesce("least", F.lit(1)).cast("long").alias("least")), "floors")
    near = parts_.join(floors, "q").where(F.col("bound") >= F.col("least")).select("q", "part")
    pairs = maxima.join(F.broadcast(long), "tid").join(near, ["q", "part"]).groupBy("q", "range").agg(F.sum(F.col("most") * F.col("times")).alias("bound"))
    pairs = pairs.join(floors, "q").where(F.col("bound") >= F.col("least")).select("q", "range", "least")
    out = settle(_best(_found(_visiting(ranges, pairs), scores, queries)).select("q", "rank", "doc_id", "score", "opened"), "found")
    for path in made:
        remove(spark, path)
    return out


def search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``TOP`` best documents for each of ``queries`` (item_id, text)."""
    spark = docs.sparkSession

    def split(batches):
        for b in parts(batches, 1, 1000):
            held = [[{"term": t, "times": c} for t, c in Counter(terms(x)).items()] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.list_(pa.struct([("term", pa.string()), ("times", pa.int64())])))], names=["item_id", "terms"])

    asked = queries.select("item_id", "text").mapInArrow(split, "item_id long, terms array<struct<term:string,times:long>>")
    asked = settle(asked.where(F.size("terms") > 0).withColumn("q", F.monotonically_increasing_id()), "asked")
    n = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n // TERMS))
    found = [_search_block(spark, docs, asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).select("q", "terms")) for k in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.join(asked.select("q", "item_id"), "q")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "q")
    return out.select("item_id", F.row_number().over(w).alias("rank"), "doc_id", "score", "opened")


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark).select("item_id", "rank", "doc_id", "score")
