"""Column expressions over aligned-read text and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bit of a duplicate read, and what stands for a position that is not a number, by layout. Fixed values.
DUPLICATE = 0x400
BAD_POS = {"sam": 987654321, "keyed": 0}
UNMAPPED = "*"


def fields(line: Column) -> Column:
    """A line's fields: tabs and spaces are alike, and trailing ones are none."""
    return F.split(F.regexp_replace(line, r"\s+$", ""), r"\s+")


def is_header(line: Column) -> Column:
    return line.startswith("@")


def strip_qname(qname: Column) -> Column:
    """What follows the last at sign."""
    return F.element_at(F.split(qname, "@"), -1)


def parse_read(line: Column, layout: str = "sam", bad_pos: int | None = None) -> Column:
    """struct(dedup_key, qname, flag, rname, pos, others) of a line, null if it has too few fields.

    ``layout`` sam has no key; ``keyed`` begins with one, and strips its qname up to the last at sign.
    """
    skip = {"sam": 0, "keyed": 1}[layout]
    bad_pos = BAD_POS[layout] if bad_pos is None else bad_pos
    f = fields(line)
    at = lambda i: F.get(f, F.lit(i + skip))
    qname = strip_qname(at(0)) if skip else at(0)
    whole = F.struct(
        (F.get(f, F.lit(0)) if skip else F.lit(None).cast("string")).alias("dedup_key"),
        qname.alias("qname"),
        at(1).try_cast("int").alias("flag"),
        at(2).alias("rname"),
        F.coalesce(at(3).try_cast("bigint"), F.lit(bad_pos).cast("bigint")).alias("pos"),
        F.slice(f, 5 + skip, F.greatest(F.size(f), F.lit(1))).alias("others"),
    )
    return F.when(F.size(f) >= 4 + skip, whole)


def debug_line(line: Column) -> Column:
    """A line with its white space normalised, or what is wrong with it."""
    f = fields(line)
    return F.when(F.size(f) < 4, F.concat(F.lit("DBG less string: "), line)).otherwise(F.array_join(f, "\t"))


def read_line(qname: Column, flag: Column, rname: Column, pos: Column, others: Column | None = None) -> Column:
    """The tab-joined line of a read."""
    head = F.array(qname, flag.cast("string"), rname, pos.cast("string"))
    return F.array_join(head if others is None else F.concat(head, others), "\t")


def mark_duplicate(flag: Column) -> Column:
    return flag.bitwiseOR(F.lit(DUPLICATE))


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def region_key(idx: Column, pos: Column, kind: str = "coarse") -> Column:
    """A contig's index and the part of it in which a position lies; an unknown contig is 0."""
    idx = F.coalesce(idx, F.lit(0)).cast("bigint")
    return {
        "coarse": lambda: idx * 1000 + F.floor(pos / 100000000),
        "fine": lambda: idx * 1000000 + F.floor(pos / 1000000),
        "modulo": lambda: idx * 10000 + F.pmod(pos, F.lit(1000)),
    }[kind]()


def shown_contig(rname: Column) -> Column:
    return F.when(rname == UNMAPPED, "unmapped").otherwise(rname)
