"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens are words, runs of letters in lower case. A run of over ``LETTERS`` letters, as scripts without spaces have them,
gives all its stretches of ``STRETCH`` letters, one from each letter on.

Learning. Labelled documents, one of each text, give for each word and each prefix of 4 and 5 letters the toxic and the
clean documents that hold it. A feature's toxic share has a Dirichlet prior of weight ``PRIOR`` whose mean is the share
of its shorter prefix, down to that of all documents; a token's log-odds is the logit of its share less the logit of the
whole. Features are counted by hash in a table of ``CELLS`` cells: all of them are in the model, whose size is fixed.

Scoring. Tokens score their log-odds less a drift that makes clean text negative. A linear-time scan (Ruzzo and Tompa)
finds all maximal segments. For a clean text of n tokens, the best segment exceeds s with probability
1 - exp(-K n exp(-lambda s)) (Karlin and Altschul): lambda is the root of E exp(lambda score) = 1 over clean tokens, K
comes from clean texts' best segments. lambda s - ln(K n) is a segment's evidence beyond chance; the best one's, and the
sum over all significant ones, go into a logistic fit on documents that the counts have not seen (two folds).

Bounds: ``TRAIN_ROWS`` labelled documents at most are learned from, chosen by a hash of doc_id, spread over the whole
table; counts of ``CELLS`` cells are collected and broadcast, 8 MB (16 while folds are learned). Every text is scored whole, all its tokens.

Defined cases. Null or empty text: no tokens, no segments, the score of a text without evidence. Labels that are null or
contradict another of the same doc_id: the larger counts, null ones do not. No labels of one kind: every score is the
share of toxic labels. Extra columns are left out by ``score_docs`` and kept by ``drop_toxic``. Repeated rows: alike. No rows: no rows.
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
from lodestar.storage import settle

TRAIN_ROWS, CELLS, LETTERS, STRETCH = 30_000, 1 << 21, 40, 6
PRIOR, DRIFT, FLOOR = 10.0, 1.0, 0.3
WORDS = re.compile(r"[^\W\d_]+")
MEMO = 150_000
#: Bins of token scores. A share is a count of documents smoothed three times: its logit is far within them.
EDGES = np.linspace(-40, 40, 1601)


def tokens(text: str | None) -> list[str]:
    words = WORDS.findall((text or "").lower())
    if max(map(len, words), default=0) <= LETTERS:
        return words
    return [t for w in words for t in ([w] if len(w) <= LETTERS else [w[i : i + STRETCH] for i in range(len(w) - STRETCH + 1)])]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prefixes(word: str) -> list[str]:
    """Features of a token, the shortest first; prefixes are marked by a caret."""
    return [f"^{word[:k]}" for k in (4, 5) if len(word) > k] + [word]


def cells(word: str) -> list[int]:
    """Where the features of a token are counted."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (CELLS - 1) for f in prefixes(word)]


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, end), by the linear-time scan of Ruzzo and Tompa."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        low, high, first = before, total, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= high:
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
        found.append((low, high, first, i + 1))
    return [(high - low, first, end) for low, high, first, end in found]


class Lexicon:
    """Token scores from the toxic and the clean documents of each cell, and of all."""

    def __init__(self, counts: tuple[np.ndarray, np.ndarray], toxic: int, clean: int):
        self.counts, self.base = counts, (toxic + 0.5) / (toxic + clean + 1.0)
        self.zero = math.log(self.base / (1 - self.base))
        self.memo: dict[str, float] = {}

    def score(self, word: str) -> float:
        share, (toxic, clean) = self.base, self.counts
        for cell in cells(word):
            t, c = int(toxic[cell]), int(clean[cell])
            share = (t + PRIOR * share) / (t + c + PRIOR)
        value = self.memo[word] = math.log(share / (1 - share)) - self.zero - DRIFT
        return value

    def scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                self.score(w)
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))


def compact(scores: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Alternating sums of runs of positive and of other scores, and where runs begin: segments are the same."""
    up = scores > 0
    begin = np.flatnonzero(np.diff(up, prepend=not up[0])) if len(up) else np.zeros(0, int)
    return (np.add.reduceat(scores, begin).tolist() if len(begin) else []), begin


class Scorer:
    """Lexicon and calibration."""

    def __init__(self, lexicon: Lexicon, rate: float = 1.0, log_k: float = 0.0, fit: tuple[float, float, float] | None = None):
        self.lexicon, self.rate, self.log_k, self.fit = lexicon, rate, log_k, fit

    def passages(self, text: str | None) -> list[tuple[float, int, int]]:
        """(evidence, first token, end token) of the significant passages."""
        return self.read(text)[2]

    def read(self, text: str | None) -> tuple[float, float, list[tuple[float, int, int]]]:
        """The best segment's evidence, the logarithm of one plus the sum of all that is positive, and the passages
        that have it."""
        s = self.lexicon.scores(tokens(text))
        if not len(s) or s.max() <= 0:
            return -math.log1p(len(s)), 0.0, []
        runs, begin = compact(s)
        chance, ends = self.log_k + math.log(len(s)), np.append(begin, len(s))
        found = [(self.rate * x - chance, a, b) for x, a, b in segments(runs)]
        beyond = [(e, int(begin[a]), int(ends[b])) for e, a, b in found if e > 0]
        return max(e for e, _, _ in found), math.log1p(sum(e for e, _, _ in beyond)), beyond

    def judge(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """The score of a text and its significant passages."""
        if self.fit is None:
            return self.lexicon.base, []
        best, total, beyond = self.read(text)
        z = self.fit[0] + self.fit[1] * max(best, -20.0) + self.fit[2] * total
        return 1 / (1 + math.exp(-max(min(z, 700), -700))), beyond

    def value(self, text: str | None) -> float:
        return self.judge(text)[0]


def karlin_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(rate * score) = 1."""
    p = weights / weights.sum()
    if values.max() <= 0 or (p * values).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Newton's method with step halving on a ridge-penalised logistic likelihood; x has a column of ones first."""

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-8:
            size /= 2
        if now - new < 1e-9 * max(1.0, now):
            break
        w, now = w + size * step, new
    return w


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y, fold) of the labelled documents to learn from: one of each text, TRAIN_ROWS at most or so."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    slim = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("_h")).join(marks, "doc_id")
    slim = settle(slim.groupBy("_h").agg(F.min("doc_id").alias("_id"), F.max("y").alias("y")), "labelled")
    part = min(1.0, TRAIN_ROWS / max(slim.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "_id"), 11).cast("double") * F.lit(2.0**-53)
    chosen = slim.where(draw < part).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(2)).cast("int"))
    out = docs.select("doc_id", "text").join(chosen, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")))
    return settle(out.dropDuplicates(["doc_id"]).select("doc_id", "text", "y", "fold"), "training")


def _counts(training: DataFrame) -> dict[int, tuple[tuple[np.ndarray, np.ndarray], int, int]]:
    """For each fold, and for both under None: toxic and clean documents by cell, and in all."""

    def run(batches):
        forget()
        for b in parts(batches, 1, 1000):
            held: dict[int, int] = Counter()
            for text, y, fold in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held.update({c << 2 | y << 1 | fold for w in set(tokens(text)) for c in cells(w)})
            flat, n = (np.fromiter(x, np.int64, len(held)) for x in (held, held.values()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (flat >> 2, flat >> 1 & 1, flat & 1)), pa.array(n)], names=["cell", "y", "fold", "n"])

    totals = {(r["fold"], r["y"]): r["count"] for r in training.groupBy("fold", "y").count().collect()}
    flat = training.mapInArrow(run, "cell int, y int, fold int, n long").groupBy("cell", "y", "fold").agg(F.sum("n").cast("int").alias("n")).toArrow()
    at = [flat[c].to_numpy() for c in ("fold", "y", "cell")]
    table = np.zeros((2, 2, CELLS), np.int32)
    table[tuple(at)] = flat["n"].to_numpy()
    total = lambda f, y: totals.get((f, y), 0)
    narrow = lambda x: x.astype(np.uint16) if x.max() < 1 << 16 else x  # noqa: E731  each worker holds what is sent
    out = {f: ((narrow(table[f, 1]), narrow(table[f, 0])), total(f, 1), total(f, 0)) for f in (0, 1)}
    return out | {None: ((narrow(table[0, 1] + table[1, 1]), narrow(table[0, 0] + table[1, 0])), total(0, 1) + total(1, 1), total(0, 0) + total(1, 0))}


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    sc = docs.sparkSession.sparkContext
    training = _training(docs, labels)
    counts = _counts(training)
    held, toxic, clean = counts[None]
    whole = Lexicon(held, toxic, clean)
    if not toxic or not clean:
        return Scorer(whole)
    folds = sc.broadcast([counts[0], counts[1]])

    def features(rate, log_k, clean_only):
        """Each document by the counts of the other fold: evidence, or a histogram of token scores with best segments."""

        def run(batches):
            pair = [Scorer(Lexicon(*c), rate, log_k) for c in folds.value]
            for b in parts(batches, 1, 1000):
                rows = []
                for text, y, fold in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    scorer = pair[1 - fold]
                    if clean_only:
                        if not y and len(s := scorer.lexicon.scores(tokens(text))):
                            runs = compact(s)[0]
                            rows.append((y, max([x for x, _, _ in segments(runs)], default=0.0), math.log(len(s)), np.histogram(s, EDGES)[0].tolist()))
                    else:
                        rows.append((y, *scorer.read(text)[:2], []))
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                hist = pa.array(cols[3], pa.list_(pa.int64()))
                if clean_only and rows:  # one histogram for the batch
                    hist = pa.array([np.sum(cols[3], axis=0).tolist()] + [[]] * (len(rows) - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), hist], names=["y", "a", "b", "hist"])

        return training.mapInArrow(run, "y int, a double, b double, hist array<long>").toPandas()

    clean_rows = features(1.0, 0.0, True)
    histogram = np.sum([h for h in clean_rows["hist"] if len(h)], axis=0) if len(clean_rows) else np.zeros(len(EDGES) - 1)
    rate = karlin_rate((EDGES[:-1] + EDGES[1:])[histogram > 0] / 2, histogram[histogram > 0]) if histogram.sum() else 1.0
    # the mean of a Gumbel variable is ln(K n) + Euler's constant, in units of the rate
    log_k = float((rate * clean_rows["a"] - clean_rows["b"]).mean()) - 0.5772156649015329 if len(clean_rows) else 0.0
    rows = features(rate, log_k, False)
    x = np.column_stack([np.ones(len(rows)), np.maximum(rows["a"], -20.0), rows["b"]])
    fit = logistic(x, rows["y"].to_numpy(float))
    folds.unpersist()
    return Scorer(whole, rate, log_k, tuple(fit.tolist()))


def _sent(spark, scorer: Scorer):
    lexicon = scorer.lexicon
    return spark.sparkContext.broadcast((lexicon.counts, lexicon.base, scorer.rate, scorer.log_k, scorer.fit))


def _received(sent) -> Scorer:
    counts, base, *rest = sent.value
    own = Lexicon(counts, 0, 1)
    own.base, own.zero = base, math.log(base / (1 - base))
    return Scorer(own, *rest)


def score_docs(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, passages) of ``docs`` (doc_id, text): of each significant passage, its evidence and its first and end
    token."""
    sent = _sent(docs.sparkSession, scorer)

    def run(batches):
        forget()
        mine = _received(sent)
        kind = pa.list_(pa.struct([("evidence", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))
        for b in parts(batches, 1):
            judged = [mine.judge(t.as_py()) for t in b.column(1)]
            passages = [[{"evidence": e, "first": i, "end": j} for e, i, j in found] for _, found in judged]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([j[0] for j in judged], pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<evidence:double,first:int,end:int>>")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_docs(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= FLOOR, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    sent, at = _sent(docs.sparkSession, learn(docs, labels)), docs.columns.index("text")

    def run(batches):
        forget()
        mine = _received(sent)
        for b in parts(batches, at):
            yield b.filter(pa.array([mine.value(t.as_py()) < FLOOR for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
