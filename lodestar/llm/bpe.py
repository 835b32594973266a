"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can be inside no merged symbol, so the text is certainly cut
between the two bytes. Each word that the pre-tokenizer finds is split at those pairs, and the fragments are encoded
independently, by merges of least rank, and concatenated; only a word's last fragment carries the word end. Fragments
recur far more often than texts do and are kept in a bounded memo, as are whole words.

``WordBpe`` reads a file of the tokenizers library whose model is BPE with word ends over bytes and whose normalizer is
NFC, white space to one space, lower case. What is neither ASCII nor Latin letters goes through the library's own normalizer and pre-tokenizer,
whose Unicode tables need not be Python's. Special strings in a text give their ids. Decoding joins the tokens' strings
by spaces, as the library does for a file that names no decoder.

Defined cases. Null text: empty, no ids, decoded as the empty string. Extra columns are left out.
Repeated rows: alike. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.kept import kept, parts

#: Most words and fragments in a worker's memos or so. They have two generations: at half as many the younger takes the place
#: of the older, and what is met again is taken over.
MEMO = 300_000
#: The pre-tokenizer's pattern for words as far as ASCII goes, a fixed value of the format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: Letters of Latin script beyond ASCII, in one place of Unicode and in all its versions: they are whole characters in NFC.
LATIN = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha())
#: White space of ASCII; U+001C to U+001F are none to the format.
SPACE = "[\t-\r ]+"
LONG = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        own = {t: t for t in self.vocab}  # the halves of merges are not held a second time
        self.ranks = {tuple([own.get(x, x) for x in (m.split(" ") if isinstance(m, str) else m)]): k for k, m in enumerate(model["merges"])}
        self.letters = dict(enumerate(byte_letters()))
        self.raw = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.inside = set()
        for token in self.vocab:
            body = token.removesuffix(self.end)
            self.inside.update(map("".join, zip(body, body[1:], strict=False)))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = re.compile(WORDS, re.ASCII)
        self.latin = re.compile(f"[\\x21-\\x7e{LATIN}]+")
        self.latin_words = re.compile(WORDS.replace("a-z", f"a-z{LATIN}"), re.ASCII)
        self.space = re.compile(SPACE)
        self.fragments: dict[str, list[str]] = {}
        self.memo: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}
        self.old_spelled: dict[str, bytes] = {}
        self.strings = {i: t.encode() for t, i in (self.vocab | added).items()}

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the adjacent pair of least rank, leftmost first, until none is left."""
        if len(symbols) > LONG:
            return self._merge_long(symbols)
        ranks, none = self.ranks, len(self.ranks)
        at = [ranks.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while at and (low := min(at)) < none:
            i = at.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del at[i]
            if i:
                at[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
            if i < len(at):
                at[i] = ranks.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap over linked symbols, n log n."""
        n, ranks = len(symbols), self.ranks
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], list(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := ranks.get((live[x], live[y]))) is not None:
                    heapq.heappush(heap, (r, x, live[x], live[y]))
        return [s for s in live if s]

    def word(self, letters: str) -> list[str]:
        """Tokens of one pre-tokenized word, given by its bytes' letters."""
        inside = self.inside
        cuts = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in inside]
        out, low = [], 0
        for high in cuts:
            part = letters[low:high]
            if (tokens := self.fragments.get(part)) is None:
                tokens = self.fragments[part] = self.merge(list(part))
            out += tokens
            low = high
        part = letters[low:]
        return out + self.merge([*part[:-1], part[-1] + self.end])

    def _spell(self, letters: str) -> bytes:
        tokens = self.word(letters)
        try:
            return b"".join([self.raw[t] for t in tokens])
        except KeyError:  # a byte that the vocabulary lacks gives no token
            return b"".join([self.raw[t] for t in tokens if t in self.raw])

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk without ASCII white space, kept in the memo. Its words are kept too."""
        if (found := self.old_memo.get(chunk)) is not None:
            pass
        elif chunk.isascii():
            low = chunk.lower()
            found = self._spell(low) if low.isalpha() else b"".join(map(self._word, self.words.findall(low.translate(self.letters))))
        elif self.latin.fullmatch(low := chunk.lower()):
            found = b"".join([self._word(w.encode().decode("latin-1").translate(self.letters)) for w in self.latin_words.findall(low)])
        else:
            found = b"".join([self._word(w) for part in self.normalize(chunk).split(" ") if part for w, _ in self.pre_tokenize(part)])
        self.memo[chunk] = found
        return found

    def _word(self, letters: str) -> bytes:
        """Ids of a word, by the letters of its bytes. Only A-Z and a-z are the same as a chunk: other letters may stand for
        other bytes, and have a memo of their own."""
        memo, old = (self.memo, self.old_memo) if letters.isascii() and letters.isalpha() else (self.spelled, self.old_spelled)
        if (found := memo.get(letters)) is None:
            if (found := old.get(letters)) is None:
                found = self._spell(letters)
            memo[letters] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) + len(self.spelled) + len(self.fragments) > MEMO // 2:
            self.old_memo, self.old_spelled, self.memo, self.spelled = self.memo, self.spelled, {}, {}
            self.fragments.clear()
        ids, memo = [], self.memo
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                ids.append(np.array([self.added[part]], dtype="<u4").tobytes())
                continue
            if part.isascii():
                part = part.lower()
            for c in self.space.split(part):
                if c:
                    ids.append(memo.get(c) or self.learn(c))
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids, and the text that they decode to."""
        ids = self.ids(text)
        return ids, self.decode(ids)


def encode_decode(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_tokens, ids, decoded), or for ``digest`` with the SHA-256 of these two."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches):
        bpe = kept(f"bpe:{vocabulary}", lambda: WordBpe(vocabulary))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in parts(batches, 1, 200):
            pairs = [bpe.encode(t.as_py() or "") for t in b.column(1)]
            n = np.fromiter((len(i) // 4 for i, _ in pairs), np.int64, len(pairs))
            if digest:
                columns = {"ids_sha256": pa.array([sha(i) for i, _ in pairs], pa.string()), "decoded_sha256": pa.array([sha(d) for _, d in pairs], pa.string())}
            else:
                values = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join([i for i, _ in pairs]))])
                columns = {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values), "decoded": pa.array([d.decode() for _, d in pairs], pa.string())}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n), **columns})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9(docs: DataFrame, vocabulary: str) -> DataFrame:
    return encode_decode(docs, vocabulary, digest=True)
