"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Features. Words, runs of letters and digits in lower case, are hashed to ``BUCKETS`` buckets; a bucket's value is the root
of its count, scaled so that a text's words have length 1. Each structure statistic (``STATS``: length, word count, word
length, shares of capitals, digits, marks, line ends and others, repeated words and lines) switches on one of ``BINS``
bins, and so does each metadata column (a number by its logarithm, a string by its hash, null by a bin of its own).

Model. A bias, a weight for each feature, and ``RANK`` factors for each: a pair of features interacts by the inner
product of their factors. The sum over all pairs is half of (the squared sum less the sum of squares), so that a text is
scored in time linear in its features.

Learning. Labelled documents, one of each text, ``TRAIN_ROWS`` at most or so, chosen by a hash and spread over the whole
table, are dealt to ``SHARES`` shares. In each of ``EPOCHS`` rounds every share takes the model, goes once over its
documents in batches by adaptive gradient steps on the logistic loss, and gives its model back; their mean is the next.
A share is one row of a written table: rounds shuffle nothing, and a lost task is run again with the same result.

Bounds: a model has some ``BUCKETS`` * (``RANK`` + 1) numbers, at all sizes; ``SHARES`` of them come to the driver in a round.
Every text is scored whole.

Defined cases. Null or empty text: no words, the statistics of an empty text. Labels that are null are not learned from;
contradicting ones of one doc_id or one text: the larger counts. Labels of one kind or none: every score is the
share of label 1, with a half added to each kind. Extra columns are left out by ``score_docs`` and kept by ``keep_good``; metadata columns
that a table lacks count as null. Repeated rows: alike. No rows: no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.kept import forget, parts
from lodestar.storage import new_path, remove, settle

TRAIN_ROWS, BUCKETS, BINS, RANK = 20_000, 1 << 15, 32, 8
SHARES, EPOCHS, BATCH, STEP, RIDGE, SEED = 8, 8, 32, 0.1, 1e-5, 11
FLOOR, MEMO = 0.3, 150_000
METADATA = ("n_chars",)
WORDS = re.compile(r"[^\W_]+")
STATS = ("bytes", "words", "word length", "capitals", "digits", "marks", "end marks", "line ends", "other bytes", "distinct words", "commonest word", "repeated lines", "line length")
#: The weight of a bin, so that statistics and words count for about as much.
BIN_VALUE = 0.3
#: Kinds of bytes: capitals, small letters, digits, marks that end or part sentences, other marks, white space, line ends.
KINDS = np.array([6 if c == 10 else 5 if c in b" \t\x0b\x0c\r" else 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c in b".,;:?!'\"-" else 4 if c < 128 else 7 for c in range(256)])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _share(part: float, whole: float) -> int:
    """A bin by the root of a share, finer near 0."""
    return int(math.sqrt(part / whole) * (BINS - 1)) if whole else 0


def _log(x: float) -> int:
    """A bin by the logarithm, four in three doublings."""
    return min(BINS - 1, int(math.log2(1 + max(x, 0)) * 4 / 3))


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each of ``STATS``."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    capitals, small, digits, ends, marks, _, breaks, other = kinds
    lines = text.split("\n")
    n = len(raw)
    return [
        _log(n), _log(len(words)), _log(n / max(1, len(words))), _share(capitals, capitals + small), _share(digits, n), _share(marks, n), _share(ends, n), _share(breaks, n), _share(other, n),
        _share(len(counts), len(words)), _share(max(counts.values(), default=0), len(words)), _share(len(lines) - len(set(lines)), len(lines)), _log(n / len(lines)),
    ]


def meta_bin(value) -> int:
    if value is None or value != value:
        return BINS - 1
    if isinstance(value, str):
        return zlib.crc32(value.encode("utf-8", "surrogatepass")) % (BINS - 1)
    return min(BINS - 2, _log(min(float(value), 1e300)))


def size(n_meta: int) -> int:
    """The number of features."""
    return BUCKETS + BINS * (len(STATS) + n_meta)


class Reader:
    """Features of texts; remembers the buckets of words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def features(self, text: str | None, meta: list) -> tuple[np.ndarray, np.ndarray]:
        """(features, values), features once each."""
        words = WORDS.findall((text or "").lower())
        counts, memo = Counter(words), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in counts:
            if w not in memo:
                memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        at = np.fromiter(map(memo.__getitem__, counts), np.int64, len(counts))
        sums = np.fromiter(counts.values(), np.float64, len(counts))
        at, inverse = np.unique(at, return_inverse=True)
        value = np.sqrt(np.bincount(inverse, sums, len(at)))
        value /= max(1e-9, np.sqrt((value * value).sum()))
        bins = [*statistics(text or "", words, counts), *map(meta_bin, meta)]
        more = BUCKETS + np.arange(len(bins)) * BINS + np.array(bins)
        return np.concatenate([at, more]).astype(np.int32), np.concatenate([value, np.full(len(bins), BIN_VALUE)]).astype(np.float32)


class Machine:
    """A model: column 0 of ``table`` holds weights, the others factors; the last row's column 0 is the bias."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def start(cls, n: int) -> Machine:
        table = np.random.default_rng(SEED).normal(0, 0.05, (n + 1, RANK + 1)).astype(np.float32)
        table[:, 0] = 0
        table[n] = 0
        return cls(table)

    def forward(self, at: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds, sums of factors by text, feature rows times values); texts begin at ``begin``, none is empty."""
        x = self.table[at] * value[:, None]
        sums = np.add.reduceat(x, begin, axis=0)
        squares = np.add.reduceat((x[:, 1:] ** 2).sum(1), begin)
        return self.table[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares), sums, x

    def scores(self, at, value, begin) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(at, value, begin)[0].astype(np.float64), -500, 500)))

    def gradient(self, at, value, begin, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, their gradients, the bias's) of the summed logistic loss."""
        z, sums, x = self.forward(at, value, begin)
        off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y).astype(np.float32)
        row = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(at)))
        g = sums[row]
        g[:, 0] = 1
        g[:, 1:] -= x[:, 1:]
        g *= (off[row] * value)[:, None]
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        first = np.flatnonzero(np.diff(ranked, prepend=-1))
        return ranked[first], np.add.reduceat(g[order], first, axis=0), off.sum()

    def descend(self, seen: np.ndarray, at, value, begin, y) -> None:
        """One adaptive step; ``seen`` sums squared gradients."""
        names, g, bias = self.gradient(at, value, begin, y)
        g = g / len(begin) + RIDGE * self.table[names]
        seen[names] += g * g
        self.table[names] -= STEP * g / np.sqrt(seen[names] + 1e-8)
        bias /= len(begin)
        seen[-1, 0] += bias * bias
        self.table[-1, 0] -= STEP * bias / math.sqrt(seen[-1, 0] + 1e-8)


def _with(docs: DataFrame, metadata: tuple[str, ...], *more) -> DataFrame:
    there = [F.col(c) if c in docs.columns else F.lit(None).cast("double") for c in metadata]
    return docs.select("doc_id", "text", F.struct(*[c.alias(f"m{k}") for k, c in enumerate(there)], F.lit(0).alias("none")).alias("meta"), *more)


def _meta(column: pa.Array, n: int) -> list[list]:
    return [[r[f"m{k}"] for k in range(n)] for r in column.to_pylist()]


def _shares(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...]) -> tuple[DataFrame, str, dict[int, int]]:
    """The documents to learn from as ``SHARES`` rows (features, values, sizes, labels), where they are, and how many
    there are of each label."""
    spark, kinds = docs.sparkSession, "at array<int>, value array<float>, n int"
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    slim = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("_h")).join(marks, "doc_id")
    slim = settle(slim.groupBy("_h").agg(F.min("doc_id").alias("_id"), F.max("y").alias("y")), "labelled")
    part = min(1.0, TRAIN_ROWS / max(slim.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), "_id"), 11).cast("double") * F.lit(2.0**-53)
    chosen = slim.where(draw < part)
    totals = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    texts = _with(docs, metadata, F.xxhash64("text").alias("_t")).join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_h"))).dropDuplicates(["doc_id"])

    def read(batches):
        forget()
        reader = Reader()
        for b in parts(batches, 1, 1000):
            rows = [reader.features(t, m) for t, m in zip(b.column(1).to_pylist(), _meta(b.column(2), len(metadata)), strict=True)]
            held = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([len(r[0]) for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*held, b.column(3), b.column(4)], names=["at", "value", "n", "y", "h"])

    def bundle(table: pa.Table) -> pa.Table:
        t = table.sort_by("h").combine_chunks()
        one = lambda c, kind: pa.array([np.concatenate([x.to_numpy(zero_copy_only=False) for x in c.chunks])], pa.list_(kind))
        flat = lambda c: pa.chunked_array([x.flatten() for x in c.chunks])
        return pa.table([one(flat(t["at"]), pa.int32()), one(flat(t["value"]), pa.float32()), one(t["n"], pa.int32()), one(t["y"], pa.int32())], names=["at", "value", "n", "y"])

    rows = texts.select("doc_id", "text", "meta", "y", F.xxhash64(F.lit(9), "doc_id").alias("h")).mapInArrow(read, kinds + ", y int, h long")
    path = new_path(spark, "shares")
    made = rows.groupBy(F.pmod("h", F.lit(SHARES))).applyInArrow(bundle, "at array<int>, value array<float>, n array<int>, y array<int>")
    return settle(made, "shares", path), path, totals


def epoch(at: np.ndarray, value: np.ndarray, n: np.ndarray, y: np.ndarray, machine: Machine, seen: np.ndarray) -> None:
    """One pass over a share's documents, by batches of ``BATCH``."""
    ends = np.cumsum(n)
    for first in range(0, len(n), BATCH):
        last = min(len(n), first + BATCH)
        low, high = ends[first] - n[first], ends[last - 1]
        machine.descend(seen, at[low:high], value[low:high], ends[first:last] - n[first:last] - low, y[first:last])


class Judge:
    """A machine, or the share of label 1 where there was nothing to learn; and the metadata it reads."""

    def __init__(self, machine: Machine | None, base: float, metadata: tuple[str, ...]):
        self.machine, self.base, self.metadata = machine, base, metadata


def learn(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA) -> Judge:
    spark = docs.sparkSession
    shares, path, totals = _shares(docs, labels, metadata)
    good, all_rows = totals.get(1, 0), sum(totals.values())
    base = (good + 0.5) / (all_rows + 1)
    if not good or good == all_rows:
        remove(spark, path)
        return Judge(None, base, metadata)
    machine, seen = Machine.start(size(len(metadata))), None
    machine.table[-1, 0] = math.log(base / (1 - base))
    seen = np.zeros_like(machine.table)
    shape = machine.table.shape
    for _ in range(EPOCHS):
        sent = spark.sparkContext.broadcast((machine.table, seen))

        def run(batches, sent=sent):
            for b in batches:
                for k in range(b.num_rows):
                    table, squares = (x.copy() for x in sent.value)
                    own = Machine(table)
                    epoch(*(c.slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in b.columns), own, squares)
                    yield pa.RecordBatch.from_arrays([pa.array([own.table.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())], names=["table", "seen"])

        total, squares, n = np.zeros(shape, np.float64), np.zeros(shape, np.float64), 0
        for r in shares.mapInArrow(run, "table binary, seen binary").toLocalIterator():
            total += np.frombuffer(r["table"], np.float32).reshape(shape)
            squares += np.frombuffer(r["seen"], np.float32).reshape(shape)
            n += 1
        sent.destroy()
        machine, seen = Machine((total / n).astype(np.float32)), (squares / n).astype(np.float32)
    remove(spark, path)
    return Judge(machine, base, metadata)


def _scored(sent, base: float, n_meta: int):
    """A function from (texts, metadata) to scores."""
    reader = Reader()

    def take(texts: pa.Array, meta: pa.Array) -> np.ndarray:
        if sent is None:
            return np.full(len(texts), base)
        rows = [reader.features(t, m) for t, m in zip(texts.to_pylist(), _meta(meta, n_meta), strict=True)]
        if not rows:
            return np.zeros(0)
        n = np.array([len(r[0]) for r in rows])
        return Machine(sent.value).scores(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(n) - n)

    return take


def _sent(spark, judge: Judge):
    return spark.sparkContext.broadcast(judge.machine.table) if judge.machine else None


def score_docs(docs: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    sent, base, n = _sent(docs.sparkSession, judge), judge.base, len(judge.metadata)

    def run(batches):
        forget()
        take = _scored(sent, base, n)
        for b in parts(batches, 1, 500, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(take(b.column(1), b.column(2)), pa.float64())], names=["doc_id", "score"])

    return _with(docs, judge.metadata).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, judge: Judge) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``FLOOR`` or more."""
    sent, base, n = _sent(docs.sparkSession, judge), judge.base, len(judge.metadata)
    there = [F.col(c) if c in docs.columns else F.lit(None).cast("double") for c in judge.metadata]
    meta = F.struct(*[c.alias(f"m{k}") for k, c in enumerate(there)], F.lit(0).alias("none"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", meta.alias("meta"))

    def run(batches):
        forget()
        take = _scored(sent, base, n)
        for b in parts(batches, 1, 500, 4 << 20):
            yield b.filter(pa.array(take(b.column(1), b.column(2)) >= FLOOR, pa.bool_())).select(["row"])

    return whole.mapInArrow(run, whole.select("row").schema).select("row.*")


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_docs(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= FLOOR, 1).otherwise(0).alias("predicted"))
