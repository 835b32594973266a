"""The stages on their own input, and the whole."""

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = docs
    for _, stage in c.STAGES[:-1]:
        got = stage(spark, got, DATA).persist()
        assert got.columns == docs.columns and 0 < got.count()
    last = c.STAGES[-1][1](spark, got, DATA)
    assert last.count() == got.count()
    whole = c.run(spark, DATA)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "decoded_sha256").collect()))
    assert key(whole) == key(last)


def test_each_stage_alone(spark):
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    docs = spark.createDataFrame([(1, "the same long line\nown words", "en", "a", 28), (2, "The same long line\nother text", "en", "a", 29), (2, "The same long line\nother text", "en", "a", 29), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = stages["line dedup"](spark, docs, DATA)
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == [(1, "the same long line\nown words"), (2, "other text"), (2, "other text"), (3, "")]
    near = stages["SimHash near-dedup"](spark, docs, DATA)
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 2, 3]
    mixed = stages["mixing sources"](spark, docs, DATA)
    assert mixed.groupBy("doc_id").count().where(F.col("count") > 4).isEmpty()
    empty = docs.where("false")
    for name, stage in c.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


def test_near_dedup_goes_through_the_fingerprint_index(spark, monkeypatch):
    """The stage asks the byte-position index for all fingerprints; its links count if verified, and what it cannot see is still found."""
    import corpus_pipeline as c

    from lodestar.llm import likeness, simhash

    words = [f"w{k}" for k in range(400)]
    edited, other = words[:399] + ["x"], [f"v{k}" for k in range(400)]
    half = [w if k % 45 else f"y{k}" for k, w in enumerate(words)]  # alike by 0.8, but far in bits
    docs = spark.createDataFrame([(k, " ".join(t), None, None, 0) for k, t in enumerate((words, edited, other, half, words))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    fps = [simhash.fingerprint(" ".join(t), 5) for t in (words, edited, half)]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 < (fps[0] ^ fps[2]).bit_count()
    asked, whole = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: asked.append({r["fp"] & (1 << 64) - 1 for r in nodes.collect()}) or whole(nodes, *a))
    monkeypatch.setattr(likeness, "_band_pairs", lambda nodes: spark.createDataFrame([], "u long, v long"))
    kept = dict(c.STAGES)["SimHash near-dedup"](spark, docs, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert len(asked) == 1 and asked[0] >= set(fps)


def test_what_workers_hold_is_small(spark):
    """A stage's workers take texts in batches of 1000 rows at most, and the counts that they hold have two bytes."""
    import corpus_pipeline
    from lodestar.llm import toxicity

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        docs = spark.range(2500).coalesce(1).selectExpr("id AS doc_id", "concat('word ', id) AS text")
        assert corpus_pipeline.encode(spark, docs, "").count() == 2500

        def sizes(batches):
            for b in batches:
                yield type(b).from_pydict({"n": [b.num_rows]})

        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) == 1000
    finally:
        spark.conf.unset(key)
    training = spark.createDataFrame([(1, "foul word", 1, 0), (2, "fine word", 0, 1), (3, "foul foul", 1, 1)], "doc_id long, text string, y int, fold int")
    counts = toxicity._counts(training)
    cell = toxicity.cells("foul")[-1]
    assert [int(counts[f][0][0][cell]) for f in (0, 1, None)] == [1, 1, 2] and int(counts[None][0][1][cell]) == 0
    assert int(counts[1][0][1][toxicity.cells("word")[-1]]) == 1 and counts[None][1:] == (2, 1)
    assert all(x.dtype.itemsize == 2 for f in counts for x in counts[f][0])


def test_stars_take_no_round(spark, rows, monkeypatch):
    from lodestar.llm import components as module

    rounds, large = [], module._large
    monkeypatch.setattr(module, "_large", lambda edges: rounds.append(1) or large(edges))
    stars = spark.createDataFrame([(1, 5), (5, 1), (6, 1), (9, 7), (3, 3)], "u long, v long")
    assert rows(module.components(stars)) == [(1, 1), (5, 1), (6, 1), (7, 7), (9, 7)]
    assert not rounds
    # a centre that is another's ray, two centres of one ray, a chain, a cycle
    other = [(1, 2), (2, 3), (10, 12), (11, 12), (20, 21), (21, 22), (22, 23), (23, 24), (30, 31), (31, 32), (32, 30)]
    found = rows(module.components(spark.createDataFrame(other, "u long, v long")))
    assert found == sorted([(n, min(g)) for g in ([1, 2, 3], [10, 11, 12], [20, 21, 22, 23, 24], [30, 31, 32]) for n in g], key=str)
    assert rounds
    assert rows(module.components(spark.createDataFrame([], "u long, v long"))) == []


def test_what_is_connected_is_a_star(spark, rows, monkeypatch):
    """Near copies meet in several bands; their links are found once, and not connected a second time."""
    import random

    from lodestar.llm import components as module
    from lodestar.llm import likeness, simhash

    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 120, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = likeness.signatures(docs, 5).groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", "row", "fp", "prefix", "bands")])
    links = rows(likeness.links(docs, nodes, near=simhash.links))
    all_nodes = sorted({x for pair in links for x in pair})
    assert len(all_nodes) == len(texts)
    assert links == sorted([(x, all_nodes[0]) for x in all_nodes[1:]], key=str)
    rounds, large = [], module._large
    monkeypatch.setattr(module, "_large", lambda edges: rounds.append(1) or large(edges))
    assert len({r.component for r in module.components(spark.createDataFrame(links, "u long, v long")).collect()}) == 1
    assert not rounds


def test_few_sources_are_shared_out_in_few_jobs(spark, rows, monkeypatch):
    """The driver plans mixing in few jobs; few sources get what many would get."""
    from lodestar.llm import mix

    names = ["b", "a", None, "\U0001f600", "\uffff", "", "z", "0", "B"]
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k * k % 37)), names[k * k % 23 % 9]) for k in range(400)], "doc_id long, text string, source string").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("mix", "")
    try:
        sizes = docs.selectExpr("source AS _source", "cast(size(split(text, ' ')) AS long) AS source_size").groupBy("_source").agg(F.sum("source_size").alias("source_size"))
        few = rows(mix.source_targets(sizes))
        ours = rows(mix.op7(docs))
        jobs = len(sc.statusTracker().getJobIdsForGroup("mix"))
    finally:
        sc._jsc.clearJobGroup()
    monkeypatch.setattr(mix, "FEW", 0)
    assert few == rows(mix.source_targets(sizes)) and len(few) == len({r["source"] for r in docs.collect()})
    assert ours == rows(mix.op7(docs))
    assert jobs <= 40, jobs  # 64 before
