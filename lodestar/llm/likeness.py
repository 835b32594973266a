"""Groups of texts by the likeness of their shingle sets, exactly, through an index of set prefixes.

A text's words (as in ``simhash``) give the set of its shingles' XXH64; fewer words than a shingle has give one shingle.
The likeness of two texts is the Jaccard index of their sets, and they are linked if it is at least ``TOP / BOTTOM`` (0.8).

Take any order of all shingles and two sets of n <= m elements (equal sizes: by node) that are so alike. They share at least
o = 4 (n + m) / 9 elements, the overlap of that likeness, which is 8 n / 9 or more and 4 m / 5 or more. So an element among the
first n - 8n/9 + 1 of the smaller set is among the first m - 4m/5 + 1 of the larger one. Each distinct set is posted under its
long prefix, with a mark on the postings of the short one; where a marked posting meets one of a larger set whose size
allows the likeness, the two are candidates. Their shared lists are counted: of the two prefixes the one that ends first
has all that the sets share up to there, so that all but n - o (or m - o) of its elements are shared; and after the last
element that they share there, the rest of either set bounds what they may still share. What is left is verified on the
whole sets. No pair of that likeness is missed, and none below is linked.

The order is that of the hashes, but common shingles come last, so that texts are posted under their rarer ones: those that
more than ``COMMON`` rows hold in their prefixes, and of the texts whose prefixes hold one of these, all that more than
``COMMON`` of them hold at all. Texts are read once for each of the two counts and once for the postings, without a shuffle
of texts. Texts that share a common passage and little else then meet only sets that are hardly more than that passage.
The order saves work only; no link rests on it. The count is raised, by doubling, while more than ``COMMON_MOST`` shingles
exceed it, which bounds what is broadcast (8 bytes each).

Of many near copies not all pairs are made. Each set has ``BANDS`` bands of ``BAND_ROWS`` min-hashes; it is first compared with
the smallest set of each band that it shares, which connects nearly all of a group in as many comparisons as it has members. What
these links connect needs no further comparison: lists whose members are all connected are left alone, and in the others
only pairs that are not connected are counted and verified, those of the largest connected part with what is outside it.
Bands only save work; no link rests on them. Given an index of fingerprints (``near``, as ``simhash.links``), each set is also compared with the
smallest set of its own fingerprint, and the smallest ones of those that the index links with each other. Texts made of little but shared shingles that are not alike cost the square
of their lists.

Defined cases. Texts without words are alike. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestar.llm.components import components
from lodestar.llm.hashed import hashes, majority
from lodestar.llm.kept import forget, parts
from lodestar.storage import new_path, remove, settle

SEED = 42
BLOCK = 1 << 12
TOP, BOTTOM = 4, 5
COMMON, COMMON_MOST = 256, 1 << 20
#: A table of at most so many rows of two longs is broadcast, after it is counted; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
BANDS, BAND_ROWS = 8, 4
#: One odd factor for each min-hash.
FACTORS = np.random.default_rng(11).integers(1 << 62, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted set of one text's shingle hashes."""
    return np.unique(hashes(text, shingle))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What a set is posted under, ``common`` (sorted) being the shingles that come last."""
    if len(common) and len(found):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: len(found) - -(-TOP * len(found) // BOTTOM) + 1] if len(found) else found


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's min-hashes. Sets alike by 0.8 share a given band with probability 0.8^BAND_ROWS at least."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), BLOCK):
        part = found[k : k + BLOCK, None] * FACTORS
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(0))
    return np.array([xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, BAND_ROWS)], np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, shingle: int, common: np.ndarray | None = None) -> DataFrame:
    """(doc_id, row, node, n, fp, prefix, bands) of ``docs`` (doc_id, text): ``row`` is a hash of the text, ``node`` one of its set, fp its fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if common is None else common)

    def run(batches):
        forget()
        for b in parts(batches, 2):
            found = [hashes(t.as_py(), shingle) for t in b.column(2)]
            fps = np.array([majority(x) for x in found], np.uint64).view(np.int64)
            sets = [np.unique(x) for x in found]
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(n), pa.array(fps), _lists([prefix(s, sent.value) for s in sets]), _lists([bands(s) for s in sets])], names=["doc_id", "row", "node", "n", "fp", "prefix", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, node long, n long, fp long, prefix array<long>, bands array<long>")


def counted(docs: DataFrame, shingle: int, hot: np.ndarray | None = None) -> DataFrame:
    """(key, count) of shingles, by parts of the rows of ``docs`` (text): of all prefixes, or with ``hot`` (sorted) of the whole
    sets of those texts whose prefix holds one of them."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def wanted(text: str | None) -> np.ndarray:
        found = shingles(text, shingle)
        first = prefix(found, np.zeros(0, np.uint64))
        if sent.value is None:
            return first
        return found if np.isin(first, sent.value).any() else first[:0]

    def run(batches):
        forget()
        for b in parts(batches, 0):
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[wanted(t.as_py()) for t in b.column(0)]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "count"])

    return docs.select("text").mapInArrow(run, "key long, count long")


def _common(counts: DataFrame, most: int) -> np.ndarray:
    """The keys, sorted, that ``counts`` (key, count) have more than ``most`` times: ``COMMON_MOST`` of them at most."""
    spark = counts.sparkSession
    path = new_path(spark, "common")
    found = settle(counts.groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") > most), "common", path)
    while found.where(F.col("count") > most).count() > COMMON_MOST:
        most *= 2
    keys = np.sort(found.where(F.col("count") > most).select("key").toArrow()["key"].to_numpy().view(np.uint64))
    remove(spark, path)
    return keys


def common_shingles(docs: DataFrame, shingle: int, most: int = COMMON) -> np.ndarray:
    """The shingles that come last, sorted."""
    hot = _common(counted(docs, shingle), most)
    return np.union1d(hot, _common(counted(docs, shingle, hot), most)) if len(hot) else hot


def _small_or_not(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of ``nodes`` (row, node), the whole sets."""

    def run(batches):
        forget()
        for b in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py(), shingle) for t in b.column(1)])], names=["node", "items"])

    texts = docs.select(F.xxhash64("text").alias("row"), "text").join(nodes, "row").select("node", "text")
    return texts.mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def _up(x: Column, d: int) -> Column:
    """A quotient, rounded up."""
    return F.floor((x + (d - 1)) / d)


def _short(n: Column) -> Column:
    """How many elements of a prefix are marked."""
    return n - _up(2 * TOP * n, TOP + BOTTOM) + 1


def _smaller(n: Column, u: Column, m: Column, v: Column) -> Column:
    """Whether a set of n elements is the smaller one of two whose sizes allow the likeness."""
    return ((n < m) | ((n == m) & (u < v))) & (TOP * m <= BOTTOM * n)


def _count_allows(c: Column, n: Column, m: Column, i: Column, j: Column) -> Column:
    """Whether a set of n elements and a larger one of m can be alike that share ``c`` elements of their prefixes, the last
    of them the i-th and j-th from 0."""
    overlap = _up(TOP * (n + m), TOP + BOTTOM)
    ends = overlap - F.greatest(_up(2 * TOP * n, TOP + BOTTOM), _up(TOP * m, BOTTOM))
    return (c > ends) & (c + F.least(n - i, m - j) > overlap)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Of ``pairs`` (u, v), those that are alike. ``nodes`` (node, n, row, prefix)."""
    spark = docs.sparkSession
    pairs_path = new_path(spark, "pairs")
    pairs = settle(pairs.distinct(), "pairs", pairs_path)
    needed_path = new_path(spark, "needed")
    needed = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    needed = settle(nodes.select("row", "node").join(needed, "node").select("row", "node"), "needed", needed_path)
    sets = _sets(docs, _small_or_not(needed), shingle)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    alike = BOTTOM * shared >= TOP * (F.size("a") + F.size("b") - shared)
    out = settle(both.where(alike).select("u", "v"), "alike")
    remove(spark, pairs_path)
    remove(spark, needed_path)
    return out


def _band_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets and the smallest set that shares one of their bands."""
    banded = nodes.select("node", "n", F.posexplode("bands").alias("i", "band"))
    hearts = banded.groupBy("i", "band").agg(F.min(F.struct("n", "node")).alias("p"), F.count("*").alias("k")).where("k > 1")
    met = banded.join(hearts, ["i", "band"]).where("node <> p.node").where(TOP * F.col("n") <= BOTTOM * F.col("p.n"))
    return met.select(F.col("p.node").alias("u"), F.col("node").alias("v"))


def _near_pairs(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (u, v) of sets and the smallest set of their fingerprint, and of these, of fingerprints that ``near`` links."""
    hearts = settle(nodes.groupBy("fp").agg(F.min(F.struct("n", "node")).alias("p")).select("fp", "p.n", "p.node"), "hearts")
    fit = lambda n, m: TOP * F.greatest(n, m) <= BOTTOM * F.least(n, m)
    same = nodes.select("fp", F.col("n").alias("m"), F.col("node").alias("v")).join(hearts, "fp").where("node <> v").where(fit(F.col("n"), F.col("m"))).select(F.col("node").alias("u"), "v")
    side = lambda fp, n, node: hearts.select(F.col("fp").alias(fp), F.col("n").alias(n), F.col("node").alias(node))
    met = near(hearts.select("fp")).toDF("fu", "fv").join(side("fu", "n", "u"), "fu").join(side("fv", "m", "v"), "fv").where(fit(F.col("n"), F.col("m")))
    return same.unionAll(met.select("u", "v"))


def links(docs: DataFrame, nodes: DataFrame, shingle: int = 5, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (u, v) over ``nodes`` (node, n, row, fp, prefix, bands): they connect just those that links connect. What the first
    comparisons connect is a star, whatever number of links it has."""
    spark = nodes.sparkSession
    posted = nodes.select("node", "n", F.posexplode("prefix").alias("i", "key")).select("key", "n", "node", "i", (F.col("i") < _short(F.col("n"))).alias("short"))
    lists_path, member_path, marked_path = (new_path(spark, x) for x in ("lists", "members", "marked"))
    # counts of fixed width first: few of all keys have a list
    lists = posted.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("short").cast("int")).alias("any")).where("k > 1 and any = 1").select("key", "k")
    lists = settle(lists, "lists", lists_path)
    member = settle(posted.join(_small_or_not(lists), "key"), "members", member_path)
    one = F.struct("n", "node", "short", "i")
    twos = member.where("k = 2").groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a.short")
    twos = twos.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.i").alias("i"), F.col("b.i").alias("j"))
    twos = twos.where(_smaller(F.col("n"), F.col("u"), F.col("m"), F.col("v")))
    member = member.where("k > 2")
    first = _band_pairs(nodes)
    if near:
        first = first.unionAll(_near_pairs(nodes, near))
    stars = _verified(docs, nodes, first.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), shingle)
    known = settle(components(stars).toDF("node", "label"), "labels")
    member = member.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a list is left alone if all its members are connected; of others, the largest part is not compared with itself
    parts_of = member.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    open_lists = parts_of.where("labels > 1").select("key", F.col("most.label").alias("main"))
    # written once: what follows reads it four times
    marked = settle(member.join(open_lists, "key").select("key", *(x for x in member.columns if x not in ("key", "k")), (F.col("label") != F.col("main")).alias("far")), "marked", marked_path)
    small, large = [F.col("n"), F.col("node").alias("u"), F.col("label").alias("lu"), "i"], [F.col("n").alias("m"), F.col("node").alias("v"), F.col("label").alias("lv"), F.col("i").alias("j")]
    fit = _smaller(F.col("n"), F.col("u"), F.col("m"), F.col("v")) & (F.col("lu") != F.col("lv"))
    meet = lambda a, b: marked.where("short").where(a).select("key", *small).join(marked.where(b).select("key", *large), "key").where(fit).select("u", "v", "n", "m", "i", "j")
    pairs = twos.unionAll(meet("far", "true")).unionAll(meet("not far", "far"))
    # pairs that are not connected yet are counted over all lists that they share
    pairs = pairs.groupBy("u", "v", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    pairs = pairs.where(_count_allows(*[F.col(x) for x in "cnmij"])).select("u", "v")
    # of what is connected, each set's link to the least of its part: the parts need not be found again
    rays = known.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    out = settle(rays.unionAll(_verified(docs, nodes, pairs, shingle)), "links")
    for p in (lists_path, member_path, marked_path):
        remove(spark, p)
    return out


def like_groups(docs: DataFrame, shingle: int = 5, most: int = COMMON, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, row, group) of every row of ``docs`` (doc_id, text). ``near`` gives links (u, v) of distinct fingerprints (fp)."""
    spark = docs.sparkSession
    wide_path, nodes_path = new_path(spark, "signatures"), new_path(spark, "sets")
    wide = settle(signatures(docs, shingle, common_shingles(docs, shingle, most)), "signatures", wide_path)
    rows = settle(wide.select("doc_id", "row", "node"), "rows")
    firsts = [F.min(c).alias(c) for c in ("n", "row", "fp", "prefix", "bands")]
    nodes = settle(wide.where("n > 0").groupBy("node").agg(*firsts), "sets", nodes_path)
    remove(spark, wide_path)
    groups = components(links(docs, nodes, shingle, near))
    remove(spark, nodes_path)
    return rows.join(groups, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("group"))
