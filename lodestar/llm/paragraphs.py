"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or each piece of up to ``PIECE`` words of a longer line; its digest is a 64-bit hash. The sketch of a
text's set of digests is ``CELLS`` cells in three equal parts. Each digest goes into one cell of each part: the cell adds
one to its count and XORs the digest and a check hash of it into its sums. Two sketches are subtracted cell by cell;
what both texts hold cancels out. Peeling takes the digests off: a cell whose count is 1 or -1 and whose check fits
holds a single digest, which is removed from its other cells, round after round. If cells are left over, the sketch was
too small: a larger one is tried, made of as many such sketches as the digests need, each digest in one of them by its own bits
(so that work grows with the digests), and parts that fail again are dealt anew, twice as finely each time, ``RETRIES``
times in all and with other hash functions. Parts that fail even then are compared digest by digest.

Likeness is the Jaccard likeness of the digest sets, (a + b - d) / (a + b + d), with d the digests recovered. A fingerprint
begins with the number of digests.

Only DataFrame operations, and no shuffle but the one that brings a document and its next together: documents are dealt
to ranges of doc_id, and the largest doc_id of each range also to the range above it, so that no task holds more than a
range. A hot source or group of copies is of no account to it.

Defined cases. Null text: empty. Two texts without digests are alike, 1. Rows that repeat a doc_id follow one another, by
a hash of their text. A null doc_id comes last in descending order. One row: its next document is itself. Extra columns
are left out. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.ranges import let as _let
from lodestar.llm.ranges import range_of
from lodestar.storage import settle

PIECE, CELLS, ROUNDS, RETRIES = 32, 30, 7, 3
#: Digests of both texts that one sketch of a retry is to hold.
LOAD = 12
FIRST = -(2**63)
CELL = "struct<n:int,k:bigint,c:bigint>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?:[^\S\n]*+\S++){1,%d}+" % PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(101)).bitwiseAND(F.lit((1 << 40) - 1))


def _cell(key: Column, part: int, salt: int) -> Column:
    """The cell of a digest in one of the three parts."""
    third = CELLS // 3
    return (F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 20 * part).bitwiseAND(F.lit(0xFFFFF)), F.lit(third)) + part * third).cast("int")


def _cells(key: Column, salt: int) -> Column:
    return F.array(*[_cell(key, part, salt) for part in range(3)])


def sketch(keys: Column, salt: int = 0) -> Column:
    """CELLS cells (n, k, c) of an array of digests."""
    entry = F.transform(keys, lambda h: F.struct(h.alias("k"), _check(h).alias("c"), _cells(h, salt).alias("at")))
    empty = F.expr("named_struct('n', 0, 'k', 0L, 'c', 0L)")

    def fill(entries):
        def one(i):
            mine = F.filter(entries, lambda e: F.array_contains(e["at"], i))
            return F.aggregate(mine, empty, lambda s, e: F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c")))

        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), one)

    return _let(entry, fill)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, salt: int = 0, rounds: int = ROUNDS) -> Column:
    """struct(left: cells that are not empty, found: array of (n, k)) after peeling a difference of sketches."""
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))
    start = F.struct(cells.alias("cells"), F.expr("cast(array() as array<struct<n:int,k:bigint,c:bigint>>)").alias("found"))

    def step(state, _):
        singles = F.array_distinct(F.filter(state["cells"], pure))

        def take(taken):
            with_at = F.transform(taken, lambda t: F.struct(t.alias("t"), _cells(t["k"], salt).alias("at")))

            def off(marked):
                def one(c, i):
                    mine = F.filter(marked, lambda m: F.array_contains(m["at"], i))
                    return F.aggregate(mine, c, lambda s, m: F.struct((s["n"] - m["t"]["n"]).alias("n"), s["k"].bitwiseXOR(m["t"]["k"]).alias("k"), s["c"].bitwiseXOR(m["t"]["c"]).alias("c")))

                return F.transform(state["cells"], one)

            return F.when(F.size(taken) == 0, state).otherwise(F.struct(_let(with_at, off).alias("cells"), F.concat(state["found"], taken).alias("found")))

        return _let(singles, take)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return _let(done, lambda s: F.struct(F.size(F.filter(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))).alias("left"), s["found"].alias("found")))


def _deal(x: Column, y: Column, attempt: int) -> Column:
    """Parts of two arrays of digests by the digests' own bits, as array of (x, y): time and room grow with the digests."""
    n = F.shiftleft(F.ceil((F.size(x) + F.size(y)) / F.lit(LOAD)).cast("int"), attempt - 1)
    mark = lambda keys, side: F.transform(keys, lambda h: F.struct(F.pmod(F.xxhash64(h, F.lit(1000 + attempt)), n).alias("p"), F.lit(side).alias("s"), h.alias("h")))

    def slices(both):
        size = F.size(both)
        begins = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at(both, i)["p"] != F.element_at(both, F.greatest(i - 1, F.lit(1)))["p"]))
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(size + 1))
        return F.zip_with(begins, ends, lambda i, j: F.slice(both, i, j - i))

    of = lambda part, side: F.transform(F.filter(part, lambda e: e["s"] == side), lambda e: e["h"])
    return F.transform(_let(F.array_sort(F.concat(mark(x, 1), mark(y, -1))), slices), lambda part: F.struct(of(part, 1).alias("x"), of(part, -1).alias("y")))


def differing(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key columns, _x, _y: arrays of digests) as one row or more for each pair, with _found: the digests
    that differ, as (n, k, c) with n = 1 for those of _x and -1 for those of _y."""
    keys = [c for c in pairs.columns if c not in ("_x", "_y")]
    none, nothing = F.expr(f"cast(array() as array<{CELL}>)"), F.expr("cast(array() as array<bigint>)")

    def peeled(df: DataFrame, salt: int) -> DataFrame:
        open_ = F.size("_x") + F.size("_y") > 0
        df = df.withColumn("_diff", F.when(open_, subtract(sketch(F.col("_x"), salt), sketch(F.col("_y"), salt))))
        return df.withColumn("_p", F.when(open_, peel(F.col("_diff"), salt))).drop("_diff")

    rows = peeled(pairs.withColumn("_got", none), 0)
    for attempt in range(1, RETRIES + 1):
        done = F.struct(nothing.alias("x"), nothing.alias("y"), F.concat("_got", F.coalesce(F.col("_p.found"), none)).alias("got"))
        more = F.transform(_deal(F.col("_x"), F.col("_y"), attempt), lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), none.alias("got")))
        rows = rows.select(*keys, F.explode(F.when(F.coalesce(F.col("_p.left"), F.lit(0)) == 0, F.array(done)).otherwise(more)).alias("_e"))
        rows = peeled(rows.select(*keys, F.col("_e.x").alias("_x"), F.col("_e.y").alias("_y"), F.col("_e.got").alias("_got")), attempt)
    side = lambda left, right, n: F.transform(F.array_except(left, right), lambda h: F.struct(F.lit(n).alias("n"), h.alias("k"), _check(h).alias("c")))
    exact = F.concat(side(F.col("_x"), F.col("_y"), 1), side(F.col("_y"), F.col("_x"), -1))
    found = F.when(F.coalesce(F.col("_p.left"), F.lit(0)) == 0, F.concat("_got", F.coalesce(F.col("_p.found"), none))).otherwise(exact)
    return rows.select(*keys, found.alias("_found"))


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differ).cast("double") / (n_a + n_b + differ))


def fingerprint(keys: Column, cells: Column) -> Column:
    """A string of fixed length: the number of digests and each cell's count, key sum and check sum."""
    hexed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 6, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 10, "0")))
    return F.lower(F.concat(F.lpad(F.hex(F.size(keys)), 6, "0"), F.array_join(hexed, "")))


def with_next(docs: DataFrame, n_ranges: int | None = None, most_ranges: int = 2500) -> DataFrame:
    """(doc_id, text, _keys, _next, _next_keys): each text and its digests with those of the next document in descending
    doc_id order, of the last document the first one."""
    spark = docs.sparkSession
    n_ranges = n_ranges or min(most_ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_k", F.coalesce("doc_id", F.lit(FIRST)))
    cuts = rows.select(F.percentile_approx("_k", [i / n_ranges for i in range(1, n_ranges)], 10 * n_ranges)).first()[0] if n_ranges > 1 else []
    cuts = sorted(set(cuts or []))
    ranged = rows.withColumn("_r", range_of(F.col("_k"), cuts))
    tops = sorted(map(tuple, ranged.groupBy("_r").agg(F.max("_k")).collect()))  # one row for each range
    # the top row of each range also closes the range above it, that of the last range the first
    above = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    to = lambda r, s: F.struct(r.cast("int").alias("r"), F.lit(s).alias("s"))
    both = F.array(to(F.col("_r"), 0), to(F.element_at(F.create_map(*[F.lit(x) for kv in above.items() for x in kv]), F.col("_k")), 1)) if above else F.array(to(F.col("_r"), 0))
    copies = F.when(F.col("_k").isin(list(above)), both).otherwise(F.array(to(F.col("_r"), 0)))
    dealt = ranged.select("doc_id", "text", "_k", F.xxhash64("text").alias("_h"), digests(F.col("text")).alias("_keys"), F.explode(copies).alias("_to")).select("doc_id", "text", "_k", "_h", "_keys", "_to.r", "_to.s")
    order = Window.partitionBy("r").orderBy("s", F.col("_k").desc(), "_h")
    return dealt.withColumn("_next", F.lead("text").over(order)).withColumn("_next_keys", F.lead("_keys").over(order)).where("s = 0").select("doc_id", "text", "_keys", "_next", "_next_keys")


def op1(docs: DataFrame) -> DataFrame:
    rows = with_next(docs.select("doc_id", "text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("_next", F.lit(1), half))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("_edited"), F.col("_keys").alias("_a"), F.col("_next_keys").alias("_x"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_a", digests(F.col("_edited")).alias("_e"), "_x")
    rows = settle(rows.withColumn("_id", F.monotonically_increasing_id()), "digests")  # the number is written with the row
    pair = lambda kind, keys: F.struct(F.lit(kind).alias("kind"), F.col(keys).alias("y"))
    pairs = rows.select("_id", F.col("_a").alias("_x0"), F.explode(F.array(pair(0, "_e"), pair(1, "_x"))).alias("_q")).select("_id", "_q.kind", F.col("_x0").alias("_x"), F.col("_q.y").alias("_y"))
    found = differing(pairs).select("_id", "kind", F.size("_found").alias("d"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("d")).otherwise(0))
    found = found.groupBy("_id").agg(of(0).alias("_de"), of(1).alias("_dx"))
    rows = rows.join(found, "_id").withColumn("_ca", sketch(F.col("_a"))).withColumn("_ce", sketch(F.col("_e")))
    near = lambda keys, d: likeness(F.size("_a"), F.size(keys), F.col(d))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_a"), F.col("_ca")).alias("fingerprint"), fingerprint(F.col("_e"), F.col("_ce")).alias("edited_fingerprint"), near("_e", "_de").alias("near_edited"), near("_x", "_dx").alias("near_next"))
