"""SimHash near-dedup by a byte-position inverted index with count filtering.

A text's words (A-Z lower-cased, split at white space) give shingles of ``shingle`` words, repeats included; fewer words
give one shingle, none give fingerprint zero. Bit i of the 64-bit fingerprint is 1 if it is set in over half of the
shingles' XXH64 (seed 42). Two texts are linked if their fingerprints differ in at most ``max_bits`` bits.

The index. Two fingerprints within ``max_bits`` agree in at least ``need = 8 - max_bits`` of their eight bytes. Each distinct
fingerprint is posted under its bytes with their positions. A list of single bytes holds 1/256 of all fingerprints, so
it is refined by further positions until lists are short: under ``depth`` bytes and positions at a time, ``depth`` being the
least with less than one fingerprint for four lists, as a tree over the bytes grows with the logarithm of what it holds. A posting
is the whole fingerprint: where a pair meets first, in the list of its first shared bytes, its shared positional bytes are
tallied, all eight at once and without a shuffle of counts. Pairs that reach the guaranteed minimum ``need`` are
retained and verified by their exact distance.

A list of over ``list_most`` fingerprints (near copies in great number) is not paired. Its members instead meet
at midpoints: two fingerprints differ in at most 4 bits just if some 64-bit value is within 2 bits of both, so each of
them is posted under the values within 2 bits of it (2081 for 64 bits), and all that share one are linked through its
least member. This is the exact way for the rest: it finds the same groups and
grows with the members, not their pairs. For other ``max_bits``, which have to be even, midpoints are within half as many bits.

Equal fingerprints are one node throughout. Fingerprints are computed in Python (Arrow batches); all else is DataFrame
operations. Rows that a third of the table shares are met by partial aggregation and by skew joins.

Defined cases. Null or empty text: fingerprint zero, linked like any other. A null doc_id takes part as the last of all
documents; a group of such rows alone has component_id null. Extra columns are kept by ``one_of_each``. No rows: none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.hashed import hashes, majority
from lodestar.llm.kept import forget, parts
from lodestar.llm.likeness import like_groups
from lodestar.llm.packed import pack, unpack
from lodestar.storage import new_path, remove, settle

LAST = 9223372036854775807
#: A table of at most so many list keys (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: In several lists of that length a fingerprint meets about as many others as it has midpoints.
LIST_MOST = 512


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row, fp) of every row of ``docs`` (doc_id, text); ``row`` is a hash of its text."""

    def run(batches):
        forget()
        for b in parts(batches, 2):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "row", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(depth: int) -> list[int]:
    return [_signed(sum(0xFF << (8 * p) for p in at)) for at in combinations(range(8), depth)]


def _linked(a: Column, b: Column, at: Column, depth: int, need: int, max_bits: int) -> Column:
    """Whether list ``at`` is the one of the first ``depth`` bytes that a pair shares, the tally of all its shared bytes
    reaches ``need``, and its distance is ``max_bits`` at most."""
    apart = a.bitwiseXOR(b)
    shared = [(apart.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0).cast("int") for p in range(8)]
    tally = sum(shared[1:], shared[0])
    first, before = F.lit(0).cast("long"), F.lit(0)
    for p in range(8):
        mine = F.when((shared[p] == 1) & (before < depth), F.lit(_signed(0xFF << (8 * p)))).otherwise(F.lit(0).cast("long"))
        first, before = first.bitwiseOR(mine), before + shared[p]
    here = F.element_at(F.array(*[F.lit(m) for m in _masks(depth)]), at.cast("int") + 1)
    return (tally >= need) & (F.bit_count(apart) <= max_bits) & (first == here)


def depth_of(n: int, need: int) -> int:
    """How many bytes at a time ``n`` fingerprints are posted under."""
    return next((d for d in range(1, need) if 4 * n < 256**d), need)


def links(nodes: DataFrame, max_bits: int = 4, list_most: int = LIST_MOST) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints of ``nodes`` (fp): every pair of lists up to ``list_most``, and for
    larger lists a star through each midpoint. They connect just those that links of at most ``max_bits`` bits connect."""
    spark, need = nodes.sparkSession, 8 - max_bits
    if not 0 < need < 8 or max_bits % 2:
        raise ValueError("max_bits is 2, 4 or 6")
    depth = depth_of(nodes.count(), need)
    spread = nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    under = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(depth))]))
    posted = spread.select("fp", under.alias("p")).select("fp", "p.at", "p.key")
    lists_path, member_path = new_path(spark, "lists"), new_path(spark, "members")
    lists = settle(posted.groupBy("at", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "lists", lists_path)
    twos = lists.where("n = 2").where(_linked(F.col("u"), F.col("v"), F.col("at"), depth, need, max_bits)).select("u", "v")
    longer = lists.where("n > 2").select("at", "key", "n")
    n_longer = longer.count()
    member = settle(posted.join(F.broadcast(longer) if n_longer <= BROADCAST_ROWS else longer, ["at", "key"]), "members", member_path)
    inside = member.where(F.col("n") <= list_most).groupBy("at", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    found = lambda a, i: F.filter(F.slice("fps", i + 2, F.size("fps")), lambda b: _linked(a, b, F.col("at"), depth, need, max_bits))
    pairs = F.flatten(F.transform("fps", lambda a, i: F.transform(found(a, i), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    pairs = twos.unionAll(inside.select(F.explode(pairs).alias("e")).select("e.u", "e.v"))

    crowd = member.where(F.col("n") > list_most).select("fp").distinct()
    # midpoints that only one member reaches fall away in the aggregation
    mid = crowd.select("fp", F.explode(F.expr(_flip_array(max_bits // 2))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    heart = mid.groupBy("mid").agg(F.min("fp").alias("u"), F.count("*").alias("k")).where("k > 1")
    stars = mid.join(heart, "mid").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    out = settle(pairs.unionAll(stars).distinct(), "links")
    for p in (lists_path, member_path):
        remove(spark, p)
    return out


def _flip_array(bits: int) -> str:
    """SQL for all 64-bit values with at most ``bits`` bits set."""
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    out = f"concat(array(0L), {one})"
    for _ in range(bits - 1):
        out = f"array_distinct(flatten(transform({out}, f -> transform(concat(array(0L), {one}), g -> f ^ g))))"
    return out


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, list_most: int = LIST_MOST) -> DataFrame:
    """(doc_id, row, fp, component_id, group) of every row of ``docs`` (doc_id, text). ``group`` is the least fingerprint of
    the row's group; unlike component_id it tells groups apart whose rows share a doc_id, or have none."""
    spark = docs.sparkSession
    fps = settle(fingerprints(docs, shingle), "fps")
    did = F.coalesce("doc_id", F.lit(LAST))
    nodes_path = new_path(spark, "nodes")
    nodes = settle(fps.groupBy("fp").agg(F.min(did).alias("node"), F.count("*").alias("n")), "nodes", nodes_path)
    groups = components(links(nodes.select("fp"), max_bits, list_most))
    # of fingerprints in a group, the least document that holds one of them
    held = groups.withColumnRenamed("node", "fp").join(nodes.select("fp", "node"), "fp")
    least = held.groupBy("component").agg(F.min("node").alias("least"))
    named = held.join(least, "component").select("fp", "least", "component")
    copies = nodes.where("n > 1").join(named.select("fp"), "fp", "left_anti").select("fp", F.col("node").alias("least"), F.col("fp").alias("component"))
    named = settle(named.unionAll(copies), "groups")
    remove(spark, nodes_path)
    out = fps.join(named, "fp", "left").select("doc_id", "row", "fp", F.coalesce("least", did).alias("component_id"), F.coalesce("component", "fp").alias("group"))
    return out.withColumn("component_id", F.when(F.col("component_id") < LAST, F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` of which each group of texts alike by 0.8 keeps its least (doc_id, row), null ids last (one row of it, if it repeats).
    Near copies are met by the index of fingerprints first; what it cannot see, as they differ in more bits, is met by ``likeness``."""
    groups = settle(like_groups(docs, shingle, near=links), "membership")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    kept = groups.groupBy("group").agg(least).select(F.col("least.doc_id").alias("_id"), F.col("least.row").alias("_row"))
    packed = pack(docs, "doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    out = packed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row"))).drop("_id", "_row")
    if not groups.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_hash"])  # it shuffles texts again, which only repeated rows call for
    return unpack(out.drop("_hash"), docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    out = near_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
