"""Text rules that several operators share. The white space of every contract is space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word: a run of anything but the six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip_white(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is quicker and the same on pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
