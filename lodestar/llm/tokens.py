"""Token-ID output as ORC, and its reader.

Each document becomes one row of ids with an end id appended. Rows lie in ascending doc_id order over files whose range
of doc_id does not overlap. ORC gives integer run-length encoding of the ids, statistics for each stripe and for each
group of ``row_stride`` rows, and Bloom filters on doc_id, so that a reader goes through stripes in parallel and skips
those that a predicate on doc_id rules out. ``first`` counts the ids before a row within its file (shard); the ids
before a shard are the sum of the shards before it.

Encoding calls the tokenizers library on what a bounded memo has not met: texts are cut before each single space between
two characters that are not white space, where the pre-tokenizer of a byte-level vocabulary always cuts, and likewise on both
sides of a single newline. Unmet pieces are encoded together: the ids of one start at the token that starts with the
space, or follow the newline's id.

Defined cases. Null text: empty, just the end id. Null doc_id: first. Repeated rows follow one another, in the order of a
hash of the text. Extra columns are left out. No rows: a folder from which no rows are read. A text that holds the
special string gives its id, as the library does by default.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.kept import kept, parts
from lodestar.llm.ranges import range_of
from lodestar.storage import new_path, settle

SCHEMA = "doc_id long, shard int, first long, n_tokens int, ids array<int>"
#: Most pieces that a worker's memo holds, some 100 MB; it starts anew beyond. Marks of pieces met once, by hash.
MEMO, SEEN = 500_000, 1 << 23
#: Bytes of texts that are encoded together.
GROUP = 8 << 20
SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: White space that is not single between other characters, or is neither space nor newline; an empty text.
ODD = "  |\n\n| \n|\n |^[ \n]|[ \n]$|^$|[\t\r\x0b\x0c\x1c-\x1f" + "".join(map(chr, SPACES)) + "]"
FIRST = -(2**63)
CUT = re.compile(r"(?<=\S) (?=\S)")
HEADS = "\r\n"
LINE = re.compile(r"(?<=\S)\n(?=\S)")


class Encoder:
    """Ids as little-endian 32-bit integers, by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.plain = re.compile(r"[^\s\x1c-\x1f]+")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        self.marks = {m: self._one(m) for m in ",."}
        self.newline = self._one("\n")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _one(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces: of " " + piece, or where a line begins, of the line feed or nothing and what follows the
        mark."""
        memo: dict[str, bytes] = {}
        heads = {p for p in pieces if p[0] in HEADS}
        self._learn_heads(heads, memo)
        pieces = pieces.difference(heads)
        # letters and the one mark after them are words of their own to the pre-tokenizer
        marked = [p for p in pieces if p[-1] in self.marks and p[:-1].isalpha()]
        pieces = pieces.difference(marked).union(q for p in marked if (q := p[:-1]) not in self.memo)
        odd = [p for p in pieces if not p.isalpha() and (not self.plain.fullmatch(p) or any(s in p for s in self.special))]
        for p in odd:
            memo[p] = self._one(" " + p)
        even = list(pieces.difference(odd))
        for k in range(0, len(even), 4096):
            part = even[k : k + 4096]
            ids = self._ids(" " + " ".join(part))
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(part):  # a piece that holds the space's own character
                memo.update((p, self._one(" " + p)) for p in part)
                continue
            raw, ends = ids.tobytes(), np.append(at[1:], len(ids)) * 4
            memo.update(zip(part, map(raw.__getitem__, map(slice, (at * 4).tolist(), ends.tolist())), strict=True))
        memo.update((p, (memo.get(q) or self.memo[q]) + self.marks[p[-1]]) for p in marked for q in (p[:-1],))
        return memo

    def _learn_heads(self, heads: set[str], memo: dict[str, bytes]) -> None:
        found, bare = {}, {p[1:] for p in heads}
        even = [p for p in bare if p.isalpha() or (self.plain.fullmatch(p) and not any(s in p for s in self.special))]
        for p in bare.difference(even):
            found[p] = self._one(p)
        for k in range(0, len(even), 4096):
            part = even[k : k + 4096]
            ids = self._ids("\n".join(part))
            at = np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0])
            raw, begins, ends = ids.tobytes(), np.append(-1, at) * 4 + 4, np.append(at, len(ids)) * 4
            found.update(zip(part, map(raw.__getitem__, map(slice, begins.tolist(), ends.tolist())), strict=True))
        memo.update((p, (self.newline if p[0] == "\n" else b"") + found[p[1:]]) for p in heads)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``, from the memo as far as it goes."""
        if len(self.memo) > MEMO:
            self.memo, self.seen = {}, bytearray(SEEN)
        memo, seen = self.memo, self.seen
        got, gone, i = list(map(memo.get, pieces)), [], -1
        for _ in range(got.count(None)):
            gone.append(i := got.index(None, i + 1))
        if gone:
            found = self.learn({pieces[i] for i in gone})
            for i in gone:
                got[i] = found[pieces[i]]
            for p, ids in found.items():  # when the memo is half full, only what is met a second time is worth keeping
                h = hash(p) & (SEEN - 1)
                if seen[h] or len(memo) < MEMO // 2:
                    memo[p] = ids
                else:
                    seen[h] = 1
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            flat: list[str] = []
            cut(t, flat)
            out.append(b"".join(self.pieces(flat)))
        return out

    def column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end_id`` after each, and each one's number of them.

        Texts whose only white space is single spaces and newlines between other characters are cut and their distinct
        pieces found by Arrow; what is left to Python is one look-up for each distinct piece of a group.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        size, parts = np.zeros(len(texts), np.int64), {}
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.frombuffer(self.encode([texts[i].as_py()])[0], "<u4")
            size[i] = len(parts[i])
        plain = np.flatnonzero(~odd)
        values = np.zeros(0, np.uint32)
        if len(plain):
            marked = pc.binary_join_element_wise(pa.scalar("\r"), pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), pa.scalar(""))
            lists = pc.split_pattern(marked, " ")
            found = lists.flatten().dictionary_encode()
            got, index = self.pieces(found.dictionary.to_pylist()), found.indices.to_numpy()
            n = np.fromiter(map(len, got), np.int32, len(got)) // 4
            first, each = (np.cumsum(n, dtype=np.int32) - n)[index], n[index]
            ends = np.append(0, np.cumsum(each, dtype=np.int64))
            at = np.repeat((first - ends[:-1]).astype(np.int32), each)
            at += np.arange(ends[-1], dtype=np.int32)
            values = np.frombuffer(b"".join(got), "<u4")[at]
            size[plain] = np.diff(ends[lists.offsets.to_numpy()])
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), end_id, np.uint32)
        mine = size[plain]
        out[np.repeat(begin[plain] - (np.cumsum(mine) - mine), mine) + np.arange(len(values))] = values
        for i, ids in parts.items():
            out[begin[i] : begin[i] + size[i]] = ids
        return out, size + 1


def cut(text: str, flat: list[str]) -> None:
    """Add the pieces of ``text`` to ``flat``. The first of each line has a mark before it: LF, of the first line CR."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in ("", " ", "\n") or not text.replace("\n", "").isprintable():
        mark = "\r"
        for line in LINE.split(text):
            pieces = CUT.split(line)
            pieces[0] = mark + pieces[0]
            flat += pieces
            mark = "\n"
    else:  # its only white space is single spaces and newlines between other characters
        flat += ("\r" + text.replace("\n", " \n")).split(" ")


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, text), which are taken in the order of each partition."""

    def run(batches):
        encoder, shard, total = kept(f"encoder:{vocabulary}", lambda: Encoder(vocabulary)), TaskContext.get().partitionId(), 0
        for part in parts(batches, 1, 1 << 30, GROUP):
            ids, n = encoder.column(part.column(1), end_id)
            edge = np.append(0, np.cumsum(n))
            ids = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(total + edge[:-1]), pa.array(n.astype(np.int32)), ids], names=["doc_id", "shard", "first", "n_tokens", "ids"])
            total += int(edge[-1])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, stripe_mb: int = 16, row_stride: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) into ORC files under ``path``. Texts are shuffled once, by range of doc_id."""
    # ranges by the ids alone: a range partitioner would read all texts to sample them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(FIRST))
    cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    keyed = docs.select("doc_id", "text", range_of(key, sorted(set(cuts or []))).cast("int").alias("_pid"))
    dealt = keyed.repartitionById(n, "_pid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    options = {"orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": str(row_stride), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "LZ4"}
    encoded(dealt, vocabulary, end_id).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows under ``path``; a filter on doc_id is pushed to the stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def shard_starts(tokens: DataFrame) -> DataFrame:
    """(shard, before): the ids in all shards before each. One row for each file."""
    ends = tokens.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))


def op2(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    tokens = read_tokens(spark, path)
    starts = settle(shard_starts(tokens.select("shard", "n_tokens")), "starts")

    def run(batches):
        for b in batches:
            ids, crc = b.column(3), []
            values = ids.values.to_numpy(zero_copy_only=False)
            edges = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[x:y].astype("<u4", copy=False).tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "first", "n_tokens", "ids_crc32"])

    out = tokens.select("doc_id", "shard", "first", "ids").mapInArrow(run, "doc_id long, shard int, first long, n_tokens long, ids_crc32 long")
    if starts.count() <= 100_000:  # one row for each file
        starts = F.broadcast(starts)
    return out.join(starts, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
