"""What a Python worker keeps from task to task: loaded vocabularies and bounded memos; and how it takes its batches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


def kept(name: str, make: Callable[[], object]):
    """The object of that name in this process, made at its first use. Functions travel by value, so module globals
    would be made anew for each task. What a process kept under another name goes: one operator's memory at a time."""
    holder = sys.modules.setdefault("_lodestar_kept", types.ModuleType("_lodestar_kept"))
    if not hasattr(holder, name):
        forget()
        setattr(holder, name, make())
        trim()  # what building it took on the way
    return getattr(holder, name)


def forget() -> None:
    """Drop all that this process keeps; operators that keep nothing call it in their tasks."""
    holder = sys.modules.get("_lodestar_kept")
    for name in [k for k in vars(holder) if not k.startswith("__")] if holder else []:
        delattr(holder, name)
    trim()


def trim() -> None:
    """Give free memory back to the system. A worker lives on after its task, idle or for other operators, and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this system's library


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on, the session's Arrow batches have ``rows`` rows at most: a task and its worker each hold a batch of texts whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, rows if now <= 0 else min(rows, now))


def groups(texts: pa.Array, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Slices (first, rows) of a column with some ``most`` bytes each and ``rows`` rows at most, a row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and (total + n > most or i - first >= rows):
            yield first, i - first
            first, total = i, 0
        total += n
    if len(size) > first:
        yield first, len(size) - first


def parts(batches: Iterable[pa.RecordBatch], text: int, rows: int = 500, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part has ``rows`` rows at most and some ``most`` bytes of column ``text``. A worker's
    memory is bounded so, whatever the session's own batch size is; once the last part is done, it goes back to the system."""
    for b in batches:
        for first, n in groups(b.column(text), most, rows):
            yield b.slice(first, n)
    b = None
    trim()
