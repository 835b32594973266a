"""The store of vectors by leaves: the same answers however it was filled, and files that no search met are not read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import kdtree, vector
from lodestar.operators.vector_store import VectorStore

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def clusters(n, seed=1, dim=3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(i % 4 * 20, 1), rnd.gauss(i % 3 * 20, 1), *[5.0] * (dim - 2)], i % 5) for i in range(n)]
    return rows + [(n + i, [1.0, 1.0, *[5.0] * (dim - 2)], None) for i in range(60)]


def brute(rows, q, own=None):
    return sorted((sum((a - b) ** 2 for a, b in zip(x, q, strict=True)) ** 0.5, i) for i, x, _ in rows if i != own)


def test_fit_and_descend(spark):
    rows = clusters(400)
    x = np.array([r[1] for r in rows])
    splits = kdtree.fit({1: x}, {1: len(x)}, 31)
    cut = {node: (dim, split) for node, dim, split in splits}
    placed = kdtree.descend(spark.createDataFrame(rows, SCHEMA), splits)
    leaf = {r["vec_id"]: r["leaf"] for r in placed.collect()}
    for i, point, _ in rows:
        at = 1
        while at in cut:
            at = 2 * at + (point[cut[at][0]] > cut[at][1])
        assert leaf[i] == at
    assert len(set(leaf.values())) > 12 and len({leaf[i] for i in range(400, 460)}) == 1  # equal rows are not parted
    again = kdtree.descend(placed, [(min(leaf.values()), 0, 1.0)])  # from the leaves that rows have
    assert {r["leaf"] for r in again.collect()} - set(leaf.values()) <= {2 * min(leaf.values()), 2 * min(leaf.values()) + 1}
    box = kdtree.boxes(placed, 3).collect()
    low, high, q = np.array([r["low"] for r in box]), np.array([r["high"] for r in box]), np.array(rows[7][1])
    assert sum(r["n"] for r in box) == len(rows)
    near, sums = kdtree.box_distances(q, low, high), kdtree.gap_sums(q, low, high)
    assert (near <= sums).all()
    in_spark = kdtree.boxes(placed, 3).select("leaf", kdtree.box_distance(F.array(*[F.lit(float(v)) for v in q])).alias("d"))
    assert {r["leaf"]: r["d"] for r in in_spark.collect()} == pytest.approx(dict(zip([r["leaf"] for r in box], near, strict=True)))
    assert kdtree.fit({1: x}, {1: len(x)}, 31, levels=2) and max(k for k, _, _ in kdtree.fit({1: x}, {1: len(x)}, 31, levels=2)) < 4
    assert kdtree.fit({1: x[400:]}, {1: 60}, 5) == []


@pytest.mark.parametrize("batches", [1, 3])
def test_inserts_and_searches(spark, tmp_path, batches):
    rows = clusters(400)
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=31)
    for k in range(batches):
        assert store.insert(spark.createDataFrame(rows[k::batches], SCHEMA)) == k + 1
    now = store.version()
    assert sorted(tuple(r) for r in store.read(now).select("vec_id", "label").collect()) == sorted(((i, lab) for i, _, lab in rows), key=lambda r: r[0])
    assert now.sizes.sum() == len(rows) and max(n for k, n in zip(now.leaves, now.sizes, strict=True) if (now.low != now.high).any(axis=1)[now.leaves.index(k)]) <= 62
    q = rows[7][1]
    got = store.in_range(q, 3.0)
    assert sorted(r["vec_id"] for r in got.collect()) == sorted(i for d, i in brute(rows, q) if d < 3.0)
    assert len(got.inputFiles()) < len(store.read(now).inputFiles()) / 2  # other folders are not read
    best = store.nearest(q, 12)
    assert [(r["rank"], r["vec_id"]) for r in best.orderBy("rank").collect()] == [(k + 1, i) for k, (_, i) in enumerate(brute(rows, q)[:12])]
    assert len(best.inputFiles()) < len(store.read(now).inputFiles()) / 2
    asked = spark.createDataFrame([r for r in rows if r[0] % 7 == 0], SCHEMA)
    each = store.nearest_of_each(asked, 4)
    want = [(r[0], k + 1, i) for r in rows if r[0] % 7 == 0 for k, (_, i) in enumerate(brute(rows, r[1], r[0])[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in each.collect()) == sorted(want)
    scan = vector.nearest_of_each(spark.createDataFrame(rows, SCHEMA), asked, 4)
    assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, each.collect()))


def test_few_leaves_are_met(spark, tmp_path, monkeypatch):
    """In clusters far apart, a query's rounds end after its own neighbourhood."""
    rows = clusters(1200)
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=20)
    store.insert(spark.createDataFrame(rows, SCHEMA))
    now, read = store.version(), []
    whole = VectorStore.read
    monkeypatch.setattr(VectorStore, "read", lambda self, version, leaves=None: read.append(leaves) or whole(self, version, leaves))
    asked = spark.createDataFrame(rows[12:16], SCHEMA)
    assert store.nearest_of_each(asked, 3).count() == 12
    met = {leaf for leaves in read for leaf in leaves}
    assert len(now.leaves) > 40 and len(met) < len(now.leaves) / 3


def test_versions_and_failures(spark, tmp_path, monkeypatch):
    rows = clusters(100)
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=40)
    store.insert(spark.createDataFrame(rows[:80], SCHEMA))
    monkeypatch.setattr(VectorStore, "_inner_boxes", staticmethod(lambda nodes: 1 / 0))
    with pytest.raises(ZeroDivisionError):  # rows are written, but no version names them
        store.insert(spark.createDataFrame(rows[80:], SCHEMA))
    monkeypatch.undo()
    assert store.versions() == [1] and store.read(store.version()).count() == 80
    store.insert(spark.createDataFrame(rows[80:], SCHEMA))
    assert store.versions() == [1, 2]
    assert store.read(store.version(1)).count() == 80 and store.read(store.version(2)).count() == len(rows)
    assert (tmp_path / "store" / "versions" / "v=000002").exists()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):  # a second writer of the same version
        spark.range(1).write.parquet(store._at(2))


def test_odd_rows(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=10)
    assert store.insert(spark.createDataFrame([], SCHEMA)) == 1
    assert store.read(store.version()).count() == 0
    assert store.nearest([0.0, 0.0], 3).count() == 0 and store.in_range([0.0, 0.0], 9.0).count() == 0
    same = [(k, [1.0, 2.0], None) for k in range(50)]
    odd = [(90, None, 1), (91, [1.0, None], 1), (92, [float("nan"), 1.0], 1), (93, [], 1), (None, [1.0, 2.5], 1), (7, [1.0, 2.0], 4)]
    store.insert(spark.createDataFrame(same + odd, SCHEMA))
    store.insert(spark.createDataFrame(same[:5], SCHEMA))
    assert store.version().sizes.sum() == 57
    assert [r["dist"] for r in store.nearest([1.0, 2.0], 57).orderBy("rank").collect()] == [0.0] * 56 + [0.5]
    asked = spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]), (8, None), (500, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r)[:3] for r in store.nearest_of_each(asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 0), (7, 2, 0), (500, 1, 0), (500, 2, 0)]


def test_blocks_are_exact():
    """Blocks of rows against blocks of queries: ties, copies, large and odd values, as measured row by row."""
    from lodestar.operators import blocks

    rnd = np.random.default_rng(3)
    for scale in (1.0, 1e6, 1e200):
        x = np.concatenate([rnd.normal(size=(300, 5)), np.ones((40, 5)), rnd.integers(0, 2, (60, 5))]) * scale + (1e6 if scale == 1 else 0)
        ids, leaf = rnd.permutation(400).astype(np.int64), np.repeat([1, 2], 200)
        if scale == 1e200:
            x[7, 2], x[8, 1] = np.inf, np.nan
        own, none = np.repeat(1, 20), np.full(20, np.nan)
        for inside in (True, False):
            at, row, far = blocks.nearest(x, ids, leaf, x[:20], ids[:20], own, none, inside, 6)
            for i in range(20):
                d = blocks.distances(x, np.repeat(x[i : i + 1], 400, 0))
                may = np.flatnonzero((ids != ids[i]) & ((leaf == 1) == inside))
                want = may[np.lexsort((ids[may], d[may]))][:6]
                assert row[at == i].tolist() == want.tolist()
                assert np.array_equal(far[at == i], d[want], equal_nan=True)


def test_blocks_of_leaves(spark, tmp_path, monkeypatch):
    """A large leaf has several blocks, small neighbours share one; answers are the same, and tasks return ``k`` rows for a query and block."""
    from lodestar.operators import vector_store

    rows = clusters(300) + [(1000 + i, [3.0, 3.0, 5.0], 1) for i in range(150)]
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=31)
    store.insert(spark.createDataFrame(rows, SCHEMA))
    now = store.version()
    dealt, sizes = now.blocks(50), dict(zip(now.leaves, now.sizes.tolist(), strict=True))
    assert sorted(k for k, _, _ in dealt) == now.leaves and all(p == -(-sizes[k] // 50) for k, _, p in dealt)
    held = {}
    for k, first, pieces in dealt:
        for b in range(first, first + pieces):
            held[b] = held.get(b, 0) + sizes[k] / pieces
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 50 and any(p > 1 for _, _, p in dealt) and len(held) < len(dealt) + 3
    monkeypatch.setattr(vector_store, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vector_store, "BLOCK_QUERIES", 9)
    asked = [r for r in rows if r[0] % 7 == 0]
    got = store.nearest_of_each(spark.createDataFrame(asked, SCHEMA), 4, step=2)
    want = [(r[0], k + 1, i) for r in asked for k, (_, i) in enumerate(brute(rows, r[1], r[0])[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted(want)


def test_small_leaves_share_folders(spark, tmp_path, monkeypatch):
    """Folders grow with an insert's rows and not with its leaves; what a later insert moved out of a shared folder is not read there."""
    from lodestar.operators import vector_store

    monkeypatch.setattr(vector_store, "SHELVES", 4)
    rows = clusters(900)
    store = VectorStore(spark, f"file://{tmp_path}/store", leaf_rows=8)
    for k in range(3):
        store.insert(spark.createDataFrame(rows[k::3], SCHEMA))
        made = [p for p in (tmp_path / "store" / "data").glob(f"gen={k + 1:06d}-*/*") if p.is_dir()]
        assert len(made) <= 9
        now = store.version(k + 1)
        assert len(now.leaves) > 30 and now.sizes.sum() == sum(len(rows[j::3]) for j in range(k + 1))
        got = store.read(now).groupBy("leaf").count().collect()
        assert {r["leaf"]: r["count"] for r in got} == dict(zip(now.leaves, now.sizes.tolist(), strict=True))
    assert sorted(r["vec_id"] for r in store.read(now).collect()) == sorted(i for i, _, _ in rows)
    some = now.leaves[::5]
    assert {r["leaf"] for r in store.read(now, some).select("leaf").distinct().collect()} == set(some)
    asked = [r for r in rows if r[0] % 20 == 0]
    each = store.nearest_of_each(spark.createDataFrame(asked, SCHEMA), 4)
    want = [(r[0], k + 1, i) for r in asked for k, (_, i) in enumerate(brute(rows, r[1], r[0])[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in each.collect()) == sorted(want)
