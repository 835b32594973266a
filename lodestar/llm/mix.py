"""Mixing sources to target weights by Pareto order sampling.

Sizes are word counts. Sources, by code point with null last, get weights that repeat ``weights``; they share ``total``
times all words, and a source that would pass ``cap`` times its own words stops there while the others share the excess
by weight. Within a source a document's expected copies are proportional to its size, rate * size, up to ``cap``; the rate is
the one at which the expected words make the target. Whole copies are allocated for certain, and what is left is the
inclusion probability p of one more. Documents are ranked by random odds over inclusion odds, (U / (1 - U)) / (p / (1 - p)),
U being a hash of doc_id and ``seed``, and the first of that order are taken, up to the place at which the words taken come
nearest to the target: a sample of unequal probabilities whose size is fixed in words.

The rate comes from each source's table of sizes with their counts. The place needs no global sort: ranks fall into bins in
groups, whose word sums show the group, and then the bin, that holds it, and only that bin's documents are ranked one by
one. A source that holds a third of all rows adds up in every task before anything is shuffled. Sources are numbered by
range partitions, and their shares found in a few rounds of sums, so that their number may be large; ``FEW`` sources or
fewer are shared out on the driver, by the same rounds, which takes one job and no table.

Only DataFrame operations. Reruns agree: nothing depends on the order or number of partitions.

Defined cases. Null text: size 0, takes nothing. Rows that agree in doc_id and size rank together. Extra columns stay as they
are in ``mixed``, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.llm.packed import pack, unpack
from lodestar.llm.text import n_words
from lodestar.storage import local, settle

#: A table of sources of at most so many rows (some 10 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: So many sources (a name and a few numbers each) are collected; of more, no more than that.
FEW = 1000
#: Expected copies within so much of a whole number are that number.
NEAR = 1e-9


def _u(seed: int) -> Column:
    """Uniform on (0, 1) from doc_id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col("_id")), 11)
    return bits.cast("double") * F.lit(2.0**-53) + F.lit(2.0**-54)


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with _k, the place of _source by code point, null last, from 0: ranges are sorted and counted apart."""
    order = F.col("_source").asc_nulls_last()
    ranged = settle(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()), "sources")
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, []
    for r in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # one row for each range
        rows.append((r["p"], before))
        before += r["count"]
    starts = sources.sparkSession.createDataFrame(rows, "_p long, _before long")
    return ranged.join(F.broadcast(starts), part == F.col("_p")).withColumn("_k", F.col("_before") + at).drop("_m", "_p", "_before")


def source_targets(sources: DataFrame, weights=(5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_source, source_size, target) for each source of ``sources`` (_source, source_size).

    What a weight of one gets is found in rounds: sources whose cap is below their share stop there and leave the rest to
    the others, whose shares grow, until no more sources stop.
    """
    named_by_text = sources.schema["_source"].dataType == StringType()
    few = sources.select("_source", "source_size").limit(FEW + 1).collect() if named_by_text else []
    if named_by_text and len(few) <= FEW:
        few.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))  # by code point, as Spark sorts
        named = [(r["_source"], r["source_size"], r["source_size"] * float(cap), float(weights[k % len(weights)])) for k, r in enumerate(few)]

        def sums(share: float) -> tuple[float, float, int]:
            full = [c <= w * share for _, _, c, w in named]
            return sum(c for f, (_, _, c, _) in zip(full, named, strict=True) if f), sum(w for f, (*_, w) in zip(full, named, strict=True) if not f), sum(n for _, n, _, _ in named)

        share = _share(sums, total)
        return local(sources.sparkSession, [(name, n, min(c, w * share)) for name, n, c, w in named], "_source string, source_size long, target double")
    by = numbered(sources).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int")))
    by = settle(by.select("_source", "source_size", "_w", (F.col("source_size") * F.lit(float(cap))).alias("_cap")), "shares")

    def sums_of_table(share: float) -> tuple[float, float, int]:
        full = F.col("_cap") <= F.col("_w") * F.lit(share)
        return by.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))), F.sum("source_size")).first()

    mine = F.col("_w") * F.lit(_share(sums_of_table, total))
    return by.select("_source", "source_size", F.when(F.col("_cap") <= mine, F.col("_cap")).otherwise(mine).alias("target"))


def _share(sums: Callable[[float], tuple[float, float, int]], total: float) -> float:
    """What a weight of one gets. ``sums`` gives, of a share, the caps of the sources that stop, the weights of the others, and all words."""
    share = 0.0
    while True:
        caps, rest, every = sums(share)
        words = total * (every or 0)
        new = (words - caps) / rest if rest else share
        if new <= share:
            return share
        share = new


def rates(sizes: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """(_source, source_size, target, _rate, _rest) from ``sizes`` (_source, _size, _n) and ``targets``, which are few enough
    to be joined by Spark's choice. _rest is the words that whole copies leave to the sample.

    With a rate at which a size just reaches the cap, larger sizes are at the cap and smaller ones below it. The largest
    size at which that makes the target or more is the largest that stays below the cap.
    """
    t = targets.withColumnRenamed("_source", "_of")
    rows = sizes.where("_size > 0").join(t, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    up = Window.partitionBy("_source").orderBy("_size")
    words, squares = F.col("_size") * F.col("_n"), F.col("_size").cast("decimal(38,0)") * F.col("_size") * F.col("_n")
    rows = rows.withColumn("_upto", F.sum(words).over(up)).withColumn("_squares", F.sum(squares.cast("decimal(38,0)")).over(up).cast("double"))
    above = (F.col("source_size") - F.col("_upto")) * F.lit(cap)
    rows = rows.withColumn("_r", (F.col("target") - above) / F.col("_squares"))
    makes = above + F.lit(cap) / F.col("_size") * F.col("_squares")
    rows = rows.withColumn("_fits", (makes >= F.col("target")) | (F.row_number().over(up) == 1))
    # within the partitions that the sums have made: no shuffle, and the sums are not made a second time for a join
    top = F.max(F.when(F.col("_fits"), F.struct("_size", "_r"))).over(Window.partitionBy("_source"))
    rows = rows.withColumn("_top", top).withColumn("_rate", F.col("_top._r"))
    whole = F.sum(F.floor(_expected(cap) + NEAR) * words)
    out = rows.groupBy("_source").agg(F.max("_rate").alias("_rate"), whole.alias("_whole_words"))
    t = targets.withColumnRenamed("_source", "_of")
    out = t.join(out, F.col("_source").eqNullSafe(F.col("_of")), "left").withColumn("_source", F.col("_of")).drop("_of")
    return out.select("_source", "source_size", "target", "_rate", (F.col("target") - F.coalesce("_whole_words", F.lit(0))).alias("_rest"))


def _expected(cap: float) -> Column:
    """Expected copies of a document of a source of known rate. A source at its cap takes all copies."""
    at_cap = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    return F.when(at_cap, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.col("_rate") * F.col("_size")))


def _id_or_least() -> Column:
    return F.coalesce("_id", F.lit(-(2**63))).alias("i")


def _inside() -> Column:
    """Whether a ranked row is before the cut. If no bin holds the cut, all rows are, or none if nothing is left to take."""
    before = F.when(F.col("_rest") <= 0, F.lit(False)).when(F.col("_edge").isNull(), F.lit(True)).when(F.col("_bin") != F.col("_edge"), F.col("_bin") < F.col("_edge"))
    return before.otherwise(F.coalesce(F.struct("_rank", _id_or_least(), "_size") <= F.col("_cut"), F.lit(False)))


def _passing(rows: DataFrame) -> DataFrame:
    """(_source, _at, _base): of each source, the ``_at`` in which the running sum of words passes _rest, and the sum before."""
    sums = rows.groupBy("_source", "_at").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"), F.first("_base").alias("_from"))
    upto = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.col("_from") + F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    return sums.where((F.col("_base") < F.col("_rest")) & (F.col("_rest") <= F.col("_base") + F.col("_words"))).select("_source", "_at", "_base")


def _on(rows: DataFrame, at: DataFrame) -> DataFrame:
    """``rows`` at the place of their source in ``at``, with its _base."""
    at = at.select(F.col("_source").alias("_of"), F.col("_at").alias("_in"), "_base")
    return rows.join(at, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_in"))).drop("_of", "_in")


def _joined(left: DataFrame, right: DataFrame, n_right: int) -> DataFrame:
    right = F.broadcast(right) if n_right <= BROADCAST_ROWS else right
    return left.join(right.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")


def _ranked(rows: DataFrame, plan: DataFrame, n: int, cap: float, seed: int, bins: int) -> DataFrame:
    """``rows`` (_id, _source, _size) at their source's plan, with _whole copies, p, rank and bin."""
    rows = _joined(rows, plan, n).withColumn("_due", F.when(F.col("_size") > 0, _expected(cap)).otherwise(0.0))
    rows = rows.withColumn("_whole", F.floor(F.col("_due") + NEAR)).withColumn("_p", F.col("_due") - F.col("_whole")).drop("_due")
    odds = (_u(seed) / (1 - _u(seed))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_rank", F.when(F.col("_p") > NEAR, odds / (1 + odds)))  # folded into (0, 1)
    return rows.withColumn("_bin", F.floor(F.col("_rank") * bins))


def plan_mix(slim: DataFrame, weights=(5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: int = 11, bins: int = 4096) -> tuple[DataFrame, int]:
    """One row for each source of ``slim`` (_id, _source, _size), with its target, rate and cut; and their number."""
    sizes = settle(slim.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "counted")
    sources = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).cast("long").alias("source_size"))
    plan = settle(rates(sizes, source_targets(sources, weights, total, cap), cap), "rates")
    n = plan.count()
    ranked = _ranked(slim, plan, n, cap, seed, bins).where("_rank is not null")
    # first the group of bins, then the bin in it, in which the running sum passes the rest; none if nothing is to be sampled
    group = int(bins**0.5)
    coarse = _passing(ranked.withColumn("_at", F.floor(F.col("_bin") / group)).withColumn("_base", F.lit(0)))
    fine = settle(_passing(_on(ranked.withColumn("_at", F.floor(F.col("_bin") / group)), coarse).withColumn("_at", F.col("_bin"))), "bins")
    edge = _on(ranked.withColumn("_at", F.col("_bin")), fine)
    within = Window.partitionBy("_source").orderBy("_rank", "_id", "_size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = edge.groupBy("_source", "_rank", "_id", "_size", "_base", "_rest").agg(F.sum("_size").alias("_here"))
    peers = peers.withColumn("_upto", F.col("_base") + F.sum("_here").over(within))
    place, below = F.struct("_upto", "_rank", _id_or_least(), "_size"), F.col("_upto") <= F.col("_rest")
    ends = peers.groupBy("_source").agg(F.max(F.when(below, place)).alias("_a"), F.min(F.when(~below, place)).alias("_b"), F.first("_base").alias("_base"), F.first("_rest").alias("_rest"))
    nearer = F.col("_b._upto") - F.col("_rest") < F.col("_rest") - F.coalesce(F.col("_a._upto"), F.col("_base"))
    last = F.when(F.coalesce(nearer, F.lit(False)), F.col("_b")).otherwise(F.col("_a"))
    cut = ends.select(F.col("_source").alias("_of"), last.alias("_l")).select("_of", F.when(F.col("_l").isNotNull(), F.struct("_l._rank", "_l.i", "_l._size")).alias("_cut"))
    held = fine.select(F.col("_source").alias("_of2"), F.col("_at").alias("_edge"))
    plan = plan.join(held, F.col("_source").eqNullSafe(F.col("_of2")), "left").drop("_of2")
    return settle(plan.join(cut, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of"), "plan"), n


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_size", n_words(F.col("text"))).withColumn("_source", F.col("source")).withColumn("_id", F.col("doc_id"))


def _taken(rows: DataFrame, plan: DataFrame, n: int, cap: float = 2.0, seed: int = 11, bins: int = 4096) -> DataFrame:
    """``rows`` with _copies, the copies that the mix takes."""
    out = _ranked(rows, plan, n, cap, seed, bins)
    more = F.when(F.col("_rank").isNotNull(), _inside().cast("int")).otherwise(0)
    return out.withColumn("_copies", (F.col("_whole") + more).cast("int"))


def mixed(docs: DataFrame, weights=(5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: int = 11, bins: int = 4096) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sized = _sized(pack(docs, "doc_id", "text", "source"))
    plan, n = plan_mix(settle(sized.select("_id", "_source", "_size"), "sizes"), weights, total, cap, seed, bins)
    out = _taken(sized, plan, n, cap, seed, bins)
    return unpack(out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("_copy"), docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    slim = settle(_sized(docs.select("doc_id", "text", "source")).select("_id", "_source", "_size"), "sizes")
    out = _taken(slim, *plan_mix(slim))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))
