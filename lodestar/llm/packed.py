"""Rows whose further columns travel as one, so that no name of theirs can clash with a name that an operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "_others"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns of ``docs``, and all others as one struct."""
    others = [c for c in docs.columns if c not in needed]
    rest = F.struct(*[F.col(_quoted(c)) for c in others]) if others else F.lit(None).cast("struct<none:int>")
    return docs.select(*needed, rest.alias(REST))


def unpack(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that were packed, in their order; ``changed`` ones by their new values."""
    needed = set(df.columns)
    at = lambda c: changed[c] if c in changed else F.col(c) if c in needed and c != REST else F.col(f"{REST}.{_quoted(c)}")
    return df.select(*[at(c).alias(c) for c in columns])
