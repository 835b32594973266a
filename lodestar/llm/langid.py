"""Language ID by a bidirectional gated recurrent network over bytes.

Two GRU layers read each window of ``WINDOW`` bytes, one forward and one backward; at every position their states give
a softmax over the languages. A document's probabilities are the mean over all its positions, of all windows of the whole
text. The network is trained here, in numpy, by backpropagation through time with Adam, on positions labelled with
their document's language.

Bounds: of each language ``LANG_ROWS`` documents or so are learned from, all where there are fewer and one at least, chosen by
a hash of doc_id and text over the whole table, with ``PER_DOC`` windows of each, evenly spaced, in ``STEPS`` steps of class-balanced batches. The weights, some 15 KB, are sent to the
executors. Many windows run side by side, longest first, so that memory is bounded by ``LANES`` windows.

Defined cases. A text that is null or has no letter: ``und``, score 0. No labelled documents: ``und`` everywhere. Null
labels are not learned from. Extra columns are left out. Repeated rows: alike. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.kept import parts
from lodestar.llm.toxicity import held_out

HIDDEN, WINDOW, LANES = 8, 128, 2048
LANG_ROWS, PER_DOC, TRAIN_WINDOW, STEPS, BATCH, RATE = 1000, 6, 64, 500, 160, 0.02
NONE = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGru:
    """Parameters: for each direction, rows of input terms by byte (update, reset, candidate) and the recurrent matrix;
    the output matrix over both states, and its bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = 1 / np.sqrt(hidden)
        make = lambda *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"E{d}": make(256, 3 * hidden), f"U{d}": make(hidden, 3 * hidden), f"V{d}": make(hidden, len(languages))}
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _step(self, d: str, x: np.ndarray, h: np.ndarray):
        n = self.hidden
        a = self.p[f"E{d}"].take(x, axis=0)
        g = h @ self.p[f"U{d}"]
        zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        return z, r, g[:, 2 * n :], c, c + z * (h - c)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions of x (time, windows) against y (windows), and its gradients by BPTT."""
        steps, m = x.shape
        n, p, kept = self.hidden, self.p, {}
        order = {"f": range(steps), "b": range(steps - 1, -1, -1)}
        states = {d: np.zeros((steps, m, n), np.float32) for d in "fb"}
        for d in "fb":
            h = np.zeros((m, n), np.float32)
            for t in order[d]:
                kept[d, t] = (h, *self._step(d, x[t], h))
                h = states[d][t] = kept[d, t][-1]
        logits = states["f"] @ p["Vf"] + states["b"] @ p["Vb"] + p["c"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        value = float(-np.log(np.maximum(prob[:, np.arange(m), y], 1e-9)).mean())
        prob[:, np.arange(m), y] -= 1
        prob /= steps * m
        grads = {"c": prob.sum((0, 1))}
        for d in "fb":
            grads[f"V{d}"] = np.tensordot(states[d], prob, ((0, 1), (0, 1)))
            from_out = prob @ p[f"V{d}"].T
            u, du = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            da = np.empty((steps, m, 3 * n), np.float32)
            dh = np.zeros((m, n), np.float32)
            for t in reversed(order[d]):
                h, z, r, gc, c, _ = kept[d, t]
                dh = dh + from_out[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                da[t] = np.concatenate([dz, dr, dc], 1)
                dg = np.concatenate([dz, dr, dc * r], 1)
                du += h.T @ dg
                dh = dh * z + dg @ u.T
            grads[f"U{d}"] = du
            de = np.zeros_like(p[f"E{d}"])
            by = np.argsort(x.ravel(), kind="stable")
            seen, first = np.unique(x.ravel()[by], return_index=True)
            de[seen] = np.add.reduceat(da.reshape(-1, 3 * n)[by], first, axis=0)
            grads[f"E{d}"] = de
        return value, grads

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> float:
        """Adam over class-balanced batches of windows (count, bytes); the last losses' mean."""
        rng, last = np.random.default_rng(seed), []
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            at = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
            value, grads = self.loss(windows[at].T, y[at])
            last = [*last[-19:], value]
            lr = rate * min(1.0, 2 * (1 - s / (steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (lr * (first[k] / (1 - 0.9**s)) / (np.sqrt(second[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return float(np.mean(last))

    def positions(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """For windows of ``data``, longest first: yields (time, active windows, probabilities there), last time first."""
        steps, p, n = int(size[0]), self.p, self.hidden
        active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right").tolist()
        ahead = np.empty((steps, len(begin), len(self.languages)), np.float32)
        h = np.zeros((len(begin), n), np.float32)
        for t, k in enumerate(active):
            h = self._step("f", data[begin[:k] + t], h[:k])[-1]
            ahead[t, :k] = h @ p["Vf"]
        ahead += p["c"]
        h = np.zeros((len(begin), n), np.float32)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            h[:k] = self._step("b", data[begin[:k] + t], h[:k])[-1]
            out = ahead[t, :k] + h[:k] @ p["Vb"]
            out -= out.max(1, keepdims=True)
            np.exp(out, out=out)
            out /= out.sum(1, keepdims=True)
            yield t, k, out

    def pooled(self, texts: list[bytes], window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
        """Mean probabilities over all positions of each text, none of them empty."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        count = -(-size // window)
        owner = np.repeat(np.arange(len(texts)), count)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(np.cumsum(size) - size, count) + index * window
        length = np.minimum(size[owner] - index * window, window)
        order = np.argsort(-length, kind="stable")
        total = np.zeros((len(owner), len(self.languages)))
        for a in range(0, len(order), lanes):
            w = order[a : a + lanes]
            mine = np.zeros((len(w), len(self.languages)), np.float32)
            for _, k, out in self.positions(data, begin[w], length[w]):
                mine[:k] += out
            total[w] = mine
        return np.add.reduceat(total, np.cumsum(count) - count, axis=0) / size[:, None]


def drawn(known: DataFrame, most: int = LANG_ROWS) -> DataFrame:
    """The rows of ``known`` (doc_id, text, lang) to learn from, ``most`` or so of each language."""
    known = known.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id", "text"), 11).cast("double") * F.lit(2.0**-53))
    # the least draw is always taken, so that no language is missed
    bound = known.groupBy("lang").agg(F.greatest(F.lit(float(most)) / F.count("*"), F.min("draw")).alias("bound"))
    bound = known.sparkSession.createDataFrame(bound.collect(), "lang string, bound double")
    return known.join(bound, "lang").where("draw <= bound").select("doc_id", "text", "lang")


def train(docs: DataFrame) -> BiGru | None:
    """The network for ``docs`` (doc_id, text, lang), from documents that are not held out."""
    spark = docs.sparkSession
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")

    def cut(batches):
        for b in parts(batches, 1):
            langs, windows = [], []
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < TRAIN_WINDOW:
                    raw = (raw + b" ") * (TRAIN_WINDOW // (len(raw) + 1) + 1)
                spread = np.unique(np.linspace(0, len(raw) - TRAIN_WINDOW, PER_DOC).astype(int)).tolist()
                langs += [lang] * len(spread)
                windows += [raw[k : k + TRAIN_WINDOW] for k in spread]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "w"])

    rows = drawn(known).mapInArrow(cut, "lang string, w binary").toArrow().sort_by([("lang", "ascending"), ("w", "ascending")])
    if not rows.num_rows:
        return None
    langs = rows["lang"].to_pylist()
    languages = sorted(set(langs))
    windows = np.frombuffer(b"".join(rows["w"].to_pylist()), np.uint8).reshape(-1, TRAIN_WINDOW)
    place = {lang: k for k, lang in enumerate(languages)}
    net = BiGru(languages)
    net.fit(windows, np.array([place[lang] for lang in langs]))
    return net


def predict(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """(doc_id, lang_pred, score) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((net.languages, net.p) if net else None)

    def run(batches):
        mine = None
        if sent.value:
            mine = BiGru(sent.value[0])
            mine.p = sent.value[1]
        for b in parts(batches, 1, 400):
            texts = b.column(1).to_pylist()
            todo = list(dict.fromkeys(t for t in texts if t and any(map(str.isalpha, t)))) if mine else []
            found = {}
            if todo:
                for t, p in zip(todo, mine.pooled([t.encode("utf-8", "surrogatepass") for t in todo]), strict=True):
                    k = int(p.argmax())
                    found[t] = mine.languages[k], float(min(p[k], 1.0))
            rows = [found.get(t, (NONE, 0.0)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
