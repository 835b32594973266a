"""Each of the ten operators against a brute-force version, SQL or a round trip, with the odd cases of its docstring."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, counts, forest, langid, likeness, line_dedup, mix, oracle, paragraphs, queries, simhash, tokens, toxicity
from lodestar.storage import shared_dir

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, _drop string, fp string"
TEXTS = [None, "", " ", "\n\n", "one", "one", "a line of ten\nA LINE of ten \nx", "a line of ten", "Ω é 12 don't <|endoftext|> ▁ z", "word " * 9000, "x" * 30000, "none\x00here \x1c   ok", "Same line here\nSame line here\nsame LINE here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "h", "d", "f") for i, t in enumerate(TEXTS)]
    rows += [(5, "one", "en", "s2", None, "h", "d", "f"), (None, "a line of ten", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1


def edited(rows):
    """(doc_id, text, edited, next text) in descending doc_id order."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + nxt[:half], nxt))
    return out


def digests(text):
    return set(re.findall(r"(?:[^\S\n]*\S+){1,32}", text, re.ASCII))


def jaccard(a, b):
    a, b = digests(a), digests(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_paragraph_sketches(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in paragraphs.op1(docs).collect()}
    for i, t, e, n in edited(pairs(docs)):
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, e)) and r["near_next"] == pytest.approx(jaccard(t, n))
    same = {}
    for i, t in pairs(docs):
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_paragraph_odd_cases(spark, odd, none):
    got = paragraphs.op1(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_edited"] <= 1 for r in got)
    assert paragraphs.op1(none).count() == 0
    alone = paragraphs.op1(spark.createDataFrame([(3, "abcd")], "doc_id bigint, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_peeling_names_the_sides(spark):
    a, b = list(range(40)), list(range(25, 70))
    df = spark.createDataFrame([(1, a, b), (2, [], []), (3, [5], [])], "id int, _x array<bigint>, _y array<bigint>")
    sides = {}
    for r in paragraphs.differing(df).collect():
        sides.setdefault(r["id"], set()).update((e["n"], e["k"]) for e in r["_found"])
    assert sides[1] == {(1, k) for k in range(25)} | {(-1, k) for k in range(40, 70)}
    assert sides[2] == set() and sides[3] == {(1, 5)}


# 2


def test_token_orc(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for docs in (documents(spark), odd.where("doc_id <> 5")):
        got = sorted(map(tuple, tokens.op2(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
        start, want = 0, []
        for i, t in sorted((i, t) for i, t in pairs(docs) if i is not None):
            ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert tokens.op2(odd, path).count() == odd.count()


def test_token_files(spark, none, tmp_path):
    import pyarrow.orc as orc

    path, out = public.path("byte_bpe_50k.json"), str(tmp_path / "ids")
    docs = documents(spark)
    tokens.write_tokens(docs, out, path)
    one = tokens.read_tokens(spark, out).where("doc_id = 7")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    files = sorted(str(p) for p in (tmp_path / "ids").glob("*.orc"))
    ranges = [(min(ids), max(ids)) for f in files if (ids := orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist())]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert tokens.op2(none, path).count() == 0


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok, enc, rnd = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "!", "é", "1", "'s", "世", " ", "\x1c", "<|endoftext|>", "Ġ", "\r", "Ex,", "."]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# 3


def brute_groups(fps, ids, bits):
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def brute_fingerprint(text, shingle=4):
    """The fingerprint by the contract's words, bit by bit."""
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n", [10, 3000])  # posted under one byte, and two at a time
@pytest.mark.parametrize("most", [512, 2])
def test_simhash_links(spark, n, most):
    rnd = random.Random(n)
    fps = {rnd.getrandbits(64) for _ in range(n // 2)}
    for f in list(fps):
        for k in (rnd.choice([1, 3, 4, 5]) for _ in range(2)):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), k)))
    fps = sorted(fps)[: 3 * n // 2]
    assert simhash.depth_of(len(fps), 4) == (1 if n == 10 else 2)
    near = {(f, g) for i, f in enumerate(fps) for g in fps[i + 1 :] if (f ^ g).bit_count() <= 4}
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(sign(f),) for f in fps], "fp long"), list_most=most).collect()}
    found = {frozenset(x % (1 << 64) for x in e) for e in got}
    if most == 512:
        assert found == {frozenset(e) for e in near}
    want, have = (brute_classes(fps, e) for e in (near, found))
    assert want == have


def brute_classes(nodes, edges):
    group = {x: {x} for x in nodes}
    for a, b in map(tuple, edges):
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("most", [256, 2])
def test_simhash(spark, most):
    docs = documents(spark).where("doc_id is not null")
    got = {r["doc_id"]: r for r in simhash.near_groups(docs, list_most=most).collect()}
    rows = pairs(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    for (i, _), f, c in zip(rows, fps, brute_groups(fps, [i for i, _ in rows], 4), strict=True):
        assert got[i]["fp"] % (1 << 64) == f and got[i]["component_id"] == c


def test_simhash_links_by_chains(spark):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64)]
    for _ in range(60):
        x = fps[-1]
        for b in rnd.sample(range(64), 4):
            x ^= 1 << b
        fps.append(x)
    fps += [rnd.getrandbits(64) for _ in range(100)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for most in (256, 2):
        edges = {tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp long"), list_most=most).collect()}
        assert edges and len({x for e in edges for x in e}) == 61


def test_simhash_odd_cases(spark, odd, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.op3(odd).collect()}
    assert got[0, "0" * 16] == got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 0
    assert simhash.op3(odd).count() == odd.count() and simhash.op3(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id in (0, 1, 2, 3)").count() == 1 and kept.where("doc_id in (4, 5)").count() == 1
    two = spark.createDataFrame([(3, "near three"), (5, "near three"), (5, "something else of its own")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in simhash.one_of_each(two).collect()) == ["near three", "something else of its own"]
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tB")


def test_one_of_each_keeps_unlinked_texts(spark):
    texts = ["rivers rise in spring when snow melts", "a clock needs winding once a week", "bread is baked before the sun is up"]
    rows = [(5, texts[0]), (5, texts[1]), *[(None, f"{t} and so on") for t in texts], (None, f"{texts[0]} and so on"), (8, texts[1]), (5, texts[1])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows[:5]))


@pytest.mark.parametrize("most", [256, 3])
def test_like_groups(spark, most):
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(300)}" for _ in range(n)] for n in (4, 60, 120, 400)]
    rows = []
    for words in base:
        for edits in (0, 1, 2, 3, 4, 6, 8, 12, 12, 3):
            new = list(words)
            for k in rnd.sample(range(len(new)), min(edits, len(new))):
                new[k] = f"v{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(new)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "the same words here", "The  same WORDS here"])]
    sets = [set(likeness.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    few = far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                root[top(i)] = top(j)
                bits = (simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[j][1], 5)).bit_count()
                few, far = few + (bits <= 4), far + (bits > 4)
    assert few and far  # more than four bits apart, too
    got, want = {}, {}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in likeness.like_groups(docs, most=most).collect():
        got.setdefault(r["group"], set()).add(r["doc_id"])
    for i in range(len(rows)):
        want.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(map(min, want.values()))


# 4


def nearest_of(x, ids, q, k=20):
    """The rows nearest to each of ``q`` (rows of x), best first, ties to smaller ids."""
    out = []
    for i in q:
        s = (x * x[i]).sum(1)
        order = np.lexsort((ids, -s))
        out.append(([int(ids[o]) for o in order if ids[o] != ids[i]][:k], s))
    return out


def recall_of(rows, x, ids, every=20):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % every == 0)
    assert set(got) == set(ids[asked].tolist())
    recall = []
    for i, (best, s) in zip(asked, nearest_of(x, ids, asked), strict=True):
        found = sorted(got[ids[i]])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert all(score == s[ids == v][0] for _, v, score in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
        recall.append(len({v for _, v, _ in found} & set(best)) / len(best))
    return np.mean(recall)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_forest(spark, size):
    v = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    p = v.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    assert recall_of(forest.op4(v).collect(), x, ids) >= 0.9


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_forest_of_many_blocks(spark, kind):
    rng = np.random.default_rng(6)
    n = 20_000
    x = rng.standard_normal((n, 32))
    if kind == "clustered":
        x = rng.standard_normal((600, 32))[rng.integers(0, 600, n)] + 0.3 * x
        x[:300] = x[0]  # copies
    x = x.astype(np.float32)
    ids = np.arange(n)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    assert recall_of(forest.neighbours(v, every=100, block_rows=3000, chunk_rows=64).collect(), x.astype(float), ids, 100) >= 0.9


def test_ascent_scores_few_rows_of_clusters():
    rng = np.random.default_rng(7)
    n = 20_000
    alike = rng.standard_normal((500, 64))[rng.integers(0, 500, n)] + 0.35 * rng.standard_normal((n, 64))
    apart = rng.standard_normal((n, 64))
    for x, most in ((alike, 0.2), (apart / np.linalg.norm(apart, axis=1)[:, None], 0.6)):
        f = forest.Forest(x, np.arange(n), np.sqrt((x * x).sum(1).max()))
        q = np.arange(0, n, 100)
        got = [set(at.tolist()) for _, at, _ in f.search(x[q], q, np.full(len(q), -np.inf), 20)]
        recall = np.mean([len(g & set(b)) / 20 for g, (b, _) in zip(got, nearest_of(x, np.arange(n), q), strict=True)])
        assert recall >= 0.9 and f.scored / len(q) / n < most


def test_few_blocks_are_visited():
    blocks = forest.cut_blocks([(8, r, p, 10) for r in range(4) for p in range(1 << 10)], 80)
    assert len(blocks) == 4 * 128 and all(parts == 1 for *_, parts in blocks)
    assert [b[4] for b in forest.cut_blocks([(8, 0, 5, 7), (8, 0, 6, 900), (8, 0, 9, 7)], 100)] == [1, 9, 1]
    near, far = forest.plan_visits(np.array([0.97]), 4, 0.06), forest.plan_visits(np.array([0.62]), 4, 0.06)
    assert near[0][0] * 0.5 ** near[1][0] < 0.001 and (far[0][0], far[1][0]) == (1, 0)
    for p in (0.7, 0.8, 0.9, 0.99):
        m, x = forest.plan_visits(np.array([p]), 4, 0.06)
        assert (1 - p ** x[0]) ** m[0] <= 0.06


def test_forest_odd_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0, None], "a"), (6, [float("nan"), 1.0], "a"), (7, [float("inf"), 1.0], "a"), (8, [], "a"), (9, [1.0, 2.0, 3.0], "a"), (10, [-3.0, 0.1], "a"), (None, [1.0, 1.0], "a"), (20, [2.0, 0.0], "a"), (0, [1.0, 0.0], "a")]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, block string")
    got = sorted(map(tuple, forest.op4(v).collect()))
    assert [g[:3] for g in got] == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (0, 4, 10), (20, 1, 0), (20, 2, 0), (20, 3, 1), (20, 4, 2), (20, 5, 10)]
    assert forest.op4(v.where("false")).count() == 0


# 5


def test_token_counts(spark, odd, none):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (documents(spark), odd):
        want = sorted((str(i), len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in pairs(docs))
        assert sorted((str(r["doc_id"]), *r[1:]) for r in counts.op5(docs, path).collect()) == want
    assert counts.op5(none, path).count() == 0


def test_transducer_is_exact():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, machine, rnd = sentencepiece.SentencePieceProcessor(model_file=path), counts.Transducer(path), random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "é", "1", "世", "▁", "<s>", "<0x41>", "🙂", "   ", "\x00", "ing", "tion", "=="]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdefghij") for _ in range(3000)), "a" * 3001, "世" * 900, " " * 2000]
    assert machine.count([t.encode() for t in texts]).tolist() == [len(sp.encode(t)) for t in texts]


def test_chunk_maps_compose_in_few_rounds():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, machine, rnd = sentencepiece.SentencePieceProcessor(model_file=path), counts.Transducer(path), random.Random(8)
    machine.restore(counts.compiled(path))
    for t in ("a" * 200_001, "=" * 70_000, "世界" * 20_000, "".join(rnd.choice("ab=") for _ in range(60_000)), " " * 50_000):
        chunks = len(t.encode()) / counts.CHUNK
        assert machine.count([t.encode()]).tolist() == [len(sp.encode(t))]
        assert machine.rounds <= np.log2(chunks) + 2 and machine.closures <= 2


def test_neighbours_fit_as_segmented():
    machine, rnd = counts.Transducer(public.path("piece_bpe_32k.model")), random.Random(9)
    pieces = [p for p in machine.scores if machine._stable(p)]
    marks = ["▁" * k for k in range(1, 17) if "▁" * k in machine.scores]
    some = [(rnd.choice(pieces), rnd.choice(pieces)) for _ in range(4000)] + [(a, b) for a in marks for b in marks] + [("a" * j, "a" * k) for j in (1, 2, 4) for k in (1, 2, 4)]
    assert all(machine._apart(a, b) == (machine._bpe(a + b) == [a, b]) for a, b in some)


# 6


def test_gradients():
    net = langid.BiGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    grads = net.loss(x, y)[1]
    for name, v in net.p.items():
        at = (int(x[2, 3]), 1) if name[0] == "E" else tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up = net.loss(x, y)[0]
        v[at] = old - 1e-4
        down = net.loss(x, y)[0]
        v[at] = old
        assert (up - down) / 2e-4 == pytest.approx(grads[name][at], abs=1e-4)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op6(docs).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.93
    net = langid.train(docs)
    pred = {r["doc_id"]: r for r in langid.predict(odd, net).collect()}
    assert all(pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert pred[4]["lang_pred"] in net.languages and 0 <= pred[9]["score"] <= 1
    assert langid.op6(none).count() == 0
    assert langid.op6(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    data = [b"ab" * 90, b"c"]
    one = net.pooled(data, window=64)
    assert np.allclose(one.sum(1), 1, atol=1e-4)


def test_every_language_is_learned_from(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id = 7 then 'rare' when id < 400 then 'few' else 'many' end as lang")
    got = {r["lang"]: r["count"] for r in langid.drawn(docs).groupBy("lang").count().collect()}
    assert got["rare"] == 1 and got["few"] == 399 and 850 < got["many"] < 1150


# 7


def xxh64(*longs, seed=42):
    """Spark's xxhash64 of whole numbers, each hashed with the hash before as seed."""
    import xxhash

    for x in longs:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed=seed % (1 << 64))
    return seed


def brute_mix(rows, seed=11):
    """{(doc_id, size, source): copies} and targets of rows (doc_id, size, source), document by document."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    totals = {n: sum(z for _, z, s in rows if s == n) for n in names}
    weights = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    capped, target = set(), {}
    while True:  # share what is left among those below their cap
        left = 1.5 * sum(totals.values()) - sum(2 * totals[s] for s in capped)
        rest = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 2.0 * totals[s] if s in capped else left * w / rest for s, w in weights.items()}
        over = {s for s in target if target[s] > 2 * totals[s]}
        if not over:
            break
        capped |= over
    copies = {}
    for n in names:
        mine = [(i, z) for i, z, s in rows if s == n]
        low, high = 0.0, 2.0  # the least document has a word: at a rate of 2 all are at the cap
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2.0, mid * z) * z for _, z in mine) < target[n] else (low, mid)
        due = {(i, z): 2.0 if n in capped else min(2.0, high * z) for i, z in mine}
        whole = {k: int(e + 1e-9) for k, e in due.items()}
        gap = target[n] - sum(whole[i, z] * z for i, z in mine)
        order = []
        for i, z in mine:
            p = due[i, z] - whole[i, z]
            if p > 1e-9:
                u = (xxh64(seed, i) >> 11) * 2.0**-53 + 2.0**-54
                order.append(((u / (1 - u)) / (p / (1 - p)), i, z))
        order.sort()
        sums = np.cumsum([0] + [z for _, _, z in order])
        n_taken = int(np.argmin(np.abs(sums - gap)))
        for i, z in mine:
            copies[i, z, n] = whole[i, z]
        for _, i, z in order[:n_taken]:
            copies[i, z, n] += 1
    return copies, target, totals


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_mix(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    got = mix.op7(docs).collect()
    if size == "sf0.001":
        assert sorted(map(tuple, got)) == sorted(map(tuple, mix.op7(docs.repartition(7)).collect()))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size_of = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    copies, target, totals = brute_mix([(i, z, source[i]) for i, z in size_of.items()])
    assert len(got) == len(size_of) and {r["size"] > 0 and r["taken"] // r["size"] for r in got} == {0, 1, 2}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == copies[r["doc_id"], r["size"], s] * r["size"]


def test_mix_odd_cases(odd, none):
    rows = mix.op7(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mix.op7(none).count() == 0
    assert mix.mixed(odd).schema == odd.schema and mix.mixed(odd).count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


def test_sources_are_numbered(spark):
    names = [None, "", "Z", "a", "\U0001f642", "\uffee", *[f"s{k}" for k in range(300)]]
    got = mix.numbered(spark.createDataFrame([(n, 1) for n in names], "_source string, source_size bigint").repartition(5)).collect()
    assert [r["_source"] for r in sorted(got, key=lambda r: r["_k"])] == [*sorted(n for n in names if n is not None), None]


# 8


def brute_segments(s, low=0, high=None):
    high = len(s) if high is None else high
    best = None
    for i in range(low, high):
        t = 0.0
        for j in range(i, high):
            t += s[j]
            if t > 0 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j + 1)
    return [] if best is None else [*brute_segments(s, low, best[1]), best, *brute_segments(s, best[2], high)]


def test_segments():
    rnd = random.Random(3)
    for _ in range(500):
        s = [rnd.choice([-3, -2, -1, 1, 2, 5]) + rnd.random() / 100 for _ in range(rnd.randint(0, 12))]
        a, b = toxicity.segments(s), brute_segments(s)
        assert [x[1:] for x in a] == [x[1:] for x in b]
        runs, begin = toxicity.compact(np.array(s))
        ends = np.append(begin, len(s))
        assert [(int(begin[i]), int(ends[j])) for _, i, j in toxicity.segments(runs)] == [x[1:] for x in b]


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op8(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
    scorer = toxicity.learn(docs, labels)
    assert scorer.passages(None) == [] and scorer.value("") < 0.3
    assert scorer.passages("the and idiot scum moron trash")[0][0] > 0
    some = labels.limit(3).unionByName(labels.limit(1).withColumn("toxic", F.lit(None).cast("int")))
    assert toxicity.op8(odd, some).count() == odd.count()
    assert toxicity.op8(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def brute_score(text, training, rate, log_k, fit):
    """The score of a text from (text, y) of the documents learned from, by the rules of the docstring."""
    words = lambda t: toxicity.tokens(t)
    features = lambda w: [f"^{w[:k]}" for k in (4, 5) if len(w) > k] + [w]
    held = [({f for w in words(t) for f in features(w)}, y) for t, y in training]
    toxic = sum(y for _, y in held)
    base = (toxic + 0.5) / (len(held) + 1)
    logit = lambda p: np.log(p / (1 - p))
    scores = []
    for w in words(text):
        share = base
        for f in features(w):
            ys = [y for fs, y in held if f in fs]
            share = (sum(ys) + 10 * share) / (len(ys) + 10)
        scores.append(logit(share) - logit(base) - 1)
    if not scores:
        best, total = 0.0, 0.0
    elif max(scores) <= 0:
        best, total = -np.log1p(len(scores)), 0.0
    else:
        found = [rate * s - log_k - np.log(len(scores)) for s, _, _ in brute_segments(scores)]
        best, total = max(found), np.log1p(sum(e for e in found if e > 0))
    return 1 / (1 + np.exp(-(fit[0] + fit[1] * max(best, -20.0) + fit[2] * total)))


def test_toxicity_scores_by_hand(spark):
    rnd = random.Random(12)
    calm, bad = ["river", "morning", "bread", "window", "travel", "garden"], ["idiotic", "idiots", "scummy"]
    rows = [(k, " ".join(rnd.choice(calm + (bad if k % 3 == 0 and j > 6 else [])) for j in range(14)), int(k % 3 == 0)) for k in range(60)]
    rows += [(60, "x" * 50, 1), (61, "", 0)]
    training = spark.createDataFrame([(i, t, y, i % 2) for i, t, y in rows], "doc_id bigint, text string, y int, fold int")
    lexicon = toxicity.Lexicon(*toxicity._counts(training)[None])
    rate, log_k, fit = 0.8, -0.5, (-1.0, 0.4, 0.9)
    scorer = toxicity.Scorer(lexicon, rate, log_k, fit)
    learned = [(t, y) for _, t, y in rows]
    texts = [*(t for t, _ in learned[:12]), "", None, "the scummy idiots", "x" * 60, "some " + "y" * 44 + " idiotic", "idiot" * 9]
    docs = spark.createDataFrame([(k, t, "more") for k, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, score string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_docs(docs, scorer).collect()}
    assert got[len(texts)] == got[0] and len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(brute_score(t, learned, rate, log_k, fit), abs=1e-9)
    assert len(toxicity.tokens("idiot" * 9)) == 40 and max(lexicon.scores(toxicity.tokens("idiot" * 9))) > 0


# 9


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for docs in (documents(spark), odd):
        want = []
        for i, t in pairs(docs):
            ids = tok.encode(t, add_special_tokens=False).ids
            want.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())))
        assert sorted((str(r["doc_id"]), *r[1:]) for r in bpe.op9(docs, path).collect()) == sorted(want)
    assert bpe.op9(none, path).count() == 0


def test_bpe_is_exact():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok, own, rnd = Tokenizer.from_file(path), bpe.WordBpe(path), random.Random(5)
    parts = ["a", "The", "s", " ", "\n", "!", "é", "1", "'s", "ß", "世", "é", "\xa0", "\x1c", "<|endoftext|>", "Σ", "İ", "½", "🙂", "\x85", "DON'T", "\u0558", "\u058b", "\ua7cb", "\U00016ea0", "\u208f", "ā", "\x01"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    latin = [*map(chr, range(0x21, 0x250)), "'s", "'ll", "e\u0301"]
    texts += ["".join(rnd.choice(latin) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (49, 400)]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        got, decoded = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert decoded.decode() == tok.decode(ids, skip_special_tokens=False) and own.decode(got) == decoded


def test_bpe_of_every_code_point():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    # every code point of planes with characters, and every 61st of those without, which are all alike
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0x33480, 0x110000, 61), *range(0xE0000, 0xE0200)]]
    texts = [" ".join(f"{form.format(c)}" for c in points[k : k + 400]) for form in ("{}", "a{}b") for k in range(0, len(points), 400)]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == e.ids


def test_bpe_whatever_came_before():
    """NUL before every letter that stands for a byte, after all those bytes were met: no memo mixes them up."""
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    met = "".join(f"{chr(c)} a{chr(c)} " for c in range(256))
    stands = [chr(c) for c in range(0x20, 0x180)]
    texts = [met, *(f"\0{c}" for c in stands), *(f"a \x01 b \0{c} {c}\0 \0{c}x c" for c in stands), "\0", "\0\0", met]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == e.ids


def test_decoded_text_is_made_of_ids(spark, tmp_path):
    import json

    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] = [{**spec["added_tokens"][0], "content": "<|other|>", "id": spec["model"]["vocab"]["the</w>"]}]
    path = tmp_path / "renamed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    row = bpe.encode_decode(spark.createDataFrame([(1, "the")], "doc_id bigint, text string"), str(path)).first()
    assert row["ids"] == [spec["model"]["vocab"]["the</w>"]] and row["decoded"] == "<|other|>"


# 10


def brute_lines(rows):
    holders = {}
    split = [(i, t.split("\n")) for i, t in rows]
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, ls in split:
        for line in ls:
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, ls in split:
        kept = [x for x in ls if len(key(x)) < 10 or i == min(holders[key(x)], key=lambda v: (v is None, v))]
        out.append((str(i), len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, odd, none, batches):
    for docs in (documents(spark), odd.select("doc_id", "text")):
        out = line_dedup.dedup_lines(docs, least_batches=batches)
        got = [(str(r["doc_id"]), len(r["_lines"]), len(r["_drop"]), hashlib.sha256(r["_kept"].encode()).hexdigest()) for r in out.collect()]
        assert sorted(got) == brute_lines(pairs(docs))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in line_dedup.op10(odd).collect()) == brute_lines(pairs(odd))
    assert line_dedup.op10(none).count() == 0
    whole = line_dedup.without_repeats(odd)
    assert whole.columns == odd.columns and whole.where("h1 = 'h' and _drop = 'd'").count() == odd.where("h1 = 'h'").count()


def test_runs_are_joined_without_shuffle_or_sort(spark):
    tables = line_dedup.HashTables(spark)
    keys = lambda a, b: tables.spark.range(a, b).selectExpr("xxhash64(id) as h1", "id as h2", "id as first").groupBy("h1", "h2").agg(F.min("first").alias("first")).transform(tables.dealt)
    runs = line_dedup.LineRuns(tables)
    runs.add(tables.write(keys(0, 4000), "run0"))
    runs.add(tables.write(keys(4000, 6000), "run0"))
    runs.add(tables.write(keys(6000, 9000), "run0"))
    assert [len(level) for level in runs.levels] == [1, 1]
    batch = tables.write(keys(1000, 9500), "keys")
    new = runs.new_of(tables.read(batch))
    assert sorted(r["h2"] for r in new.collect()) == list(range(9000, 9500))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan and "LeftAnti" in plan
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    runs.drop()
    tables.drop(batch)
    assert not tables.names


def test_batches_read_only_their_own_lines(spark, tmp_path):
    rows = [(d, 1, p, d * 31 + p, p) for d in range(200) for p in range(1 if d else 500)]
    lines = spark.createDataFrame(rows, line_dedup.LINE).repartition(3)
    out, n = line_dedup.lines_by_batch(lines, 5, str(tmp_path / "lines"))
    found = [[tuple(r)[:5] for r in out.where(F.col("_batch") == k).collect()] for k in range(n)]
    assert sorted(r for batch in found for r in batch) == sorted(rows) and all(found) and n > 1
    assert all(max(a)[0] < min(b)[0] for a, b in zip(found, found[1:], strict=False))
    plan = out.where("_batch = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_batch" in plan
    empty, n = line_dedup.lines_by_batch(lines.limit(0), 5, str(tmp_path / "none"))
    assert n == 1 and empty.count() == 0


def test_tables_go_when_a_batch_fails(spark, monkeypatch):
    before = set(os.listdir(shared_dir(spark).removeprefix("file://"))), spark.catalog.listTables()

    def fails(self, run, level=0):
        raise RuntimeError("stopped")

    monkeypatch.setattr(line_dedup.LineRuns, "add", fails)
    with pytest.raises(RuntimeError, match="stopped"):
        line_dedup.line_drops(documents(spark))
    assert (set(os.listdir(shared_dir(spark).removeprefix("file://"))), spark.catalog.listTables()) == before


def test_lines_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(oracle.SQL["op10_line_dedup"]).fetchall())
    assert sorted(map(tuple, queries.op10_line_dedup(spark, DATA).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
