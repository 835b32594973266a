"""Operators 11 to 13 against brute-force versions, SQL and held-out labels, with the odd cases of their docstrings."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import codes, quality, search

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, y string, meta string, at string"
TEXTS = [None, "", " ", "\n\n", "one", "one", "One TWO three\n### $$$", "Ω é 12 don't Ωé", "word " * 9000, "x" * 30000, "none\x00here \x1c   ok", "a b\na b\nc"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", None, None if i % 3 else 7, 0.5, "y", "m", "a") for i, t in enumerate(TEXTS)]
    rows += [(5, "one", "en", "s2", None, 0.5, "y", "m", "a"), (None, "one two", None, None, None, None, None, None, None), (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


# 11


def random_features(rnd, n, size):
    rows = [rnd.choice(size, rnd.integers(1, 9), replace=False) for _ in range(n)]
    value = [rnd.normal(size=len(r)).astype(np.float32) for r in rows]
    return rows, value, np.cumsum([0] + [len(r) for r in rows[:-1]])


def pairwise(table, at, value):
    """The log-odds with every pair of features written out."""
    z = table[-1, 0] + sum(table[a, 0] * x for a, x in zip(at, value, strict=True))
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            z += table[at[i], 1:] @ table[at[j], 1:] * value[i] * value[j]
    return z


def test_machine_sums_all_pairs():
    rnd = np.random.default_rng(1)
    machine = quality.Machine(rnd.normal(size=(21, 4)))
    rows, value, begin = random_features(rnd, 30, 20)
    got = machine.forward(np.concatenate(rows), np.concatenate(value), begin)[0]
    assert got == pytest.approx([pairwise(machine.table, a, v) for a, v in zip(rows, value, strict=True)], abs=1e-9)


def test_machine_gradient():
    rnd = np.random.default_rng(2)
    machine = quality.Machine(rnd.normal(size=(21, 4)))
    rows, value, begin = random_features(rnd, 12, 20)
    y, at, x = rnd.integers(0, 2, 12), np.concatenate(rows), np.concatenate(value)

    def loss():
        z = machine.forward(at, x, begin)[0]
        return (np.logaddexp(0, z) - y * z).sum()

    names, g, bias = machine.gradient(at, x, begin, y)
    assert names.tolist() == sorted(set(at.tolist()))
    want = np.zeros_like(machine.table)
    want[names], want[-1, 0] = g, bias
    for i in (*names[:6], 20):
        for k in range(4 if i < 20 else 1):
            machine.table[i, k] += 1e-5
            up = loss()
            machine.table[i, k] -= 2e-5
            down = loss()
            machine.table[i, k] += 1e-5
            assert want[i, k] == pytest.approx((up - down) / 2e-5, abs=1e-3)


def test_features_by_hand():
    at, value = quality.Reader().features("Aa aa b\nAa aa b\n!", [None])
    words, bins = at[at < quality.BUCKETS], at[at >= quality.BUCKETS] - quality.BUCKETS
    assert len(words) == 2 and sorted(value[:2]) == pytest.approx([math.sqrt(2 / 6), math.sqrt(4 / 6)])
    found = dict(zip([*quality.STATS, "n_chars"], (bins - np.arange(len(bins)) * quality.BINS).tolist(), strict=True))
    share = lambda x: int(math.sqrt(x) * 31)
    log = lambda x: int(math.log2(1 + x) * 4 / 3)
    assert found == {
        "bytes": log(17), "words": log(6), "word length": log(17 / 6), "capitals": share(2 / 10), "digits": 0, "end marks": share(1 / 17), "marks": 0, "line ends": share(2 / 17),
        "other bytes": 0, "distinct words": share(2 / 6), "commonest word": share(4 / 6), "repeated lines": share(1 / 3), "line length": log(17 / 3), "n_chars": 31,
    }


@pytest.mark.parametrize("sf", ["0.1"])
def test_quality_of_held_out_rows(spark, sf):
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    judge = quality.learn(docs, labels)
    got = quality.score_docs(docs, judge).withColumn("held", quality.held_out()).join(labels, "doc_id").where("held and quality is not null").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good >= quality.FLOOR).mean() > 0.98 and (bad < quality.FLOOR).mean() > 0.6
    assert np.mean([(x > bad).mean() for x in good]) > 0.95  # a good text stands above a bad one
    kept = quality.keep_good(docs, judge)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()


def test_quality_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None, "more") for k in range(40)] + [(3, None, None, ""), (None, 1, None, ""), (4, 1, None, "")], "doc_id bigint, quality int, toxic int, text string")
    got = quality.op11(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1  # repeated rows
    again = {(r["doc_id"], r["score"]) for r in quality.op11(odd, labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    assert quality.op11(none, labels).count() == 0
    one_kind = quality.op11(odd, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in one_kind}) == 1 and one_kind[0]["score"] > 0.5
    assert {r["score"] for r in quality.op11(odd, labels.where("quality > 1")).collect()} == {0.5}
    judge = quality.learn(odd, labels, ("n_chars", "lang", "not there"))
    kept = quality.keep_good(odd, judge)
    assert kept.columns == odd.columns and kept.count() == quality.score_docs(odd, judge).where("score >= 0.3").count()
    assert quality.keep_good(none, judge).count() == 0


# 12


def brute_search(docs, queries):
    """Every document scored for every query, by the contract."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(find(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in find(text) if t in c)
            scored += [(-s, math.inf if i is None else i)] if s > 0 else []
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scored)[:10])]
    return out


@pytest.mark.parametrize("sizes", [(4096, 16), (8, 2), (5, 3)])
def test_search_finds_the_best(spark, monkeypatch, sizes, rows):
    """Many small ranges of deep trees, with ties and repeated rows."""
    monkeypatch.setattr(search, "RANGE", sizes[0])
    monkeypatch.setattr(search, "FAN", sizes[1])
    rnd = random.Random(5)
    words = [*"abcdefghij", "Été", "été", "x1", "A"]
    docs = [(rnd.randrange(400), " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for _ in range(300)] + [(None, "a b x1"), (None, None), (7, "")]
    queries = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))) for k in range(30)] + [(90, None), (91, "nowhere"), (92, "a a a b x1 x1")]
    make = lambda data, name: spark.createDataFrame([(i, t, 1, "e") for i, t in data], f"{name} bigint, text string, rank int, terms string").repartition(3)
    got = rows(search.op12(make(docs, "doc_id"), make(queries, "item_id")), "item_id", "rank", "doc_id", "score")
    assert got == sorted(brute_search(docs, queries), key=str)


def test_search_in_blocks_of_terms(spark, monkeypatch, rows):
    docs, items = table(spark, "documents", "0.001"), table(spark, "benchmark", "0.001")
    whole = rows(search.op12(docs, items))
    monkeypatch.setattr(search, "TERMS", 300)
    assert rows(search.op12(docs, items)) == whole
    want = brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows(search.op12(docs, items), "item_id", "rank", "doc_id", "score") == sorted(want, key=str)


def test_search_opens_few_nodes():
    """A range in which one document holds a rare term: the way to it is opened, and nothing else."""
    term = np.concatenate([np.zeros(4096, int), [1]])
    tree = search.Tree(term, np.concatenate([np.arange(4096), [777]]), np.concatenate([np.full(4096, 5), [100]]), 4096)
    best, opened = tree.search(np.array([0, 1]), np.array([1, 2]), np.arange(4096), 200)
    assert best == [(205, 777, 777)] and opened == 3
    best, _ = tree.search(np.array([0, 1]), np.array([1, 2]), np.arange(4096)[::-1], 1)  # equal bounds are opened for their smaller doc_ids
    assert best[0] == (205, 4095 - 777, 777) and [b[1] for b in best[1:]] == list(range(9))
    assert tree.search(np.array([2]), np.array([1]), np.arange(4096), 1) == ([], 0)


def test_search_odd_cases(spark, odd, none):
    items = table(spark, "benchmark", "0.001")
    assert search.op12(none, items).count() == 0 and search.op12(odd, items.limit(0)).count() == 0
    asked = spark.createDataFrame([(1, "ONE"), (1, "ONE"), (None, "one"), (2, None)], "item_id bigint, text string")
    got = [tuple(r) for r in search.op12(odd, asked).collect()]
    assert [r[1:3] for r in got if r[0] is None] == [(1, 4), (2, 5), (3, 5), (4, 6), (5, None)]
    assert sorted(r[1] for r in got if r[0] == 1) == list(range(1, 11))


# 13


def brute_codes(rows):
    """(vec_id, label, code, error) and the digest, every entry compared with every part."""
    kept = sorted([(i, x, lab) for i, x, lab in rows if x and all(c is not None and math.isfinite(c) for c in x)], key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * c) for c in r[1]]))
    d = len(kept[0][1]) // 16
    vecs = [[[math.floor(256 * c) for c in x[p * d : p * d + d]] for p in range(16)] for _, x, _ in kept]
    books = [[list(v[p]) for v in vecs[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        names = [[near(v[p], books[p])[1] for p in range(16)] for v in vecs]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [v[p] for v, n in zip(vecs, names, strict=True) if n[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for (i, _, lab), v in zip(kept, vecs, strict=True):
        found = [near(v[p], books[p]) for p in range(16)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [3, 64, 200])
def test_codes_by_brute_force(spark, n):
    """Few values, so that ties, equal entries and unused ones abound; nulls, infinities and repeated rows."""
    rnd = random.Random(n)
    rows = [(rnd.randrange(n), [rnd.choice([-0.01, 0.0, 0.004, 0.5, -3.0]) for _ in range(32)], rnd.choice([None, 0, 1])) for _ in range(n)]
    rows += [(None, rows[0][1], 1), (1, None, 1), (0, [None] * 32, 1), (0, [math.nan] * 32, None), (0, [math.inf] + [0.0] * 31, 2), (0, [], 1)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, error int").repartition(3)
    want, digest = brute_codes(rows)
    got = [tuple(r) for r in codes.op13(df).collect()]
    assert sorted([(r[0], r[1], r[2]) for r in got], key=str) == sorted([(i, c, e) for i, _, c, e in want], key=str)
    sums = Counter()
    for _, lab, _, e in want:
        sums[lab] += e
    assert sorted(r[3] for r in got) == sorted(sums[lab] for _, lab, _, _ in want) and {r[4] for r in got} == {digest}


def test_exponion_is_exact_and_scans_less():
    rnd = np.random.default_rng(3)
    book = rnd.integers(-60, 60, (64, 4))
    points = book[rnd.integers(0, 64, 4000)] + rnd.integers(-6, 7, (4000, 4))
    all_d = ((points[:, None] - book[None]) ** 2).sum(2)
    want = all_d.argmin(1)
    for before in (rnd.integers(0, 64, 4000), want):
        entry, best, done = codes.nearest(points, book, before)
        assert (entry == want).all() and (best == all_d.min(1)).all()
    assert done < 0.2 * all_d.size  # from the right entries, few others are within the radius
    same = np.repeat(book[:1], 5, axis=0)  # equal entries: the lowest index
    assert codes.nearest(book[:1], same, np.array([4]))[0].tolist() == [0]


def test_codes_odd_cases(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert codes.op13(spark.createDataFrame([], schema)).count() == 0
    assert codes.op13(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    two = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], schema)
    assert [r["vec_id"] for r in codes.op13(two).collect()] == [1]
    with pytest.raises(ValueError):
        codes.op13(spark.createDataFrame([(1, [0.5] * 17, 1)], schema))
    with pytest.raises(Exception, match="exact 64-bit"):
        codes.op13(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))
    rows, books = codes.learn(table(spark, "embeddings", "0.001"))
    r = rows.first()
    assert ((codes.decoded(r["code"], books) * 256 - np.array(r["vec"])) ** 2).sum() == r["error"]
