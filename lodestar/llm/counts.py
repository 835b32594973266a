"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

The transducer reads bytes. Its state holds what the past can still change: the longest suffix that begins some piece,
and for each position in it from which a piece can still begin, the last token of the segmentation up to there and its
token count, less the least of these; last tokens that admit the same few pieces count as one. That least count is certain, so a transition is annotated with its growth, the
tokens it emits; a state's final output is what is still open. It rests on the fact that a token sequence is the BPE
segmentation of its string just if each two neighbours are that of theirs.

The driver compiles the machine of the vocabulary, all states that its pieces reach at the beginning of a word, once for
each model, and sends it to the workers. States that only other words reach join a worker's dense table of (state, byte)
when they are met; a full table goes back to the vocabulary's.

Many chunks run side by side. Texts are cut at spaces that follow another character, where no piece can cross and
the state is known, or after ``chunk`` bytes where there is none. A chunk's map is a table (state in -> state out, tokens)
over its domain: the known state; or else the states that the bytes before it lead to from ``STARTS`` different places,
and whatever state the map of the chunk before leads to. Maps are composed by a parallel prefix scan: in each round the
map of each chunk is followed by that of the chunk to which it leads, so that after r rounds a map spans 2^r chunks.

Defined cases. Null or empty text: no bytes, no tokens. Extra columns are left out. Repeated rows: alike. No rows: none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.kept import kept, parts

BAR = "▁"
#: Most states in a worker's table (1 KB each).
STATES = 160_000
#: Pieces that begin alike of which it is worth finding those that fit.
FEW = 10
#: Least bytes of a chunk; bytes before a chunk whose state is not known that lead to its domain, and from how many places.
CHUNK, BACK, STARTS = 256, 64, 16
#: Bytes of text that run side by side at a time.
GROUP = 4 << 20


class Transducer:
    """Counts of ``model``'s tokens. Rows of the table: next state * 64 + tokens emitted; -1 where not compiled yet."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kind = spec.normalizer_spec, {1: {}, 4: {}}
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalization is expected")
        for p in spec.pieces:
            if p.type in kind:
                kind[p.type][p.piece] = p.score
        self.scores = kind[1] | kind[4]
        if any(BAR in p.lstrip(BAR) for p in self.scores):
            raise ValueError("a piece crosses the start of a word")
        self.longer: dict[str, list[str]] = {}
        for p in self.scores:
            for k in range(1, len(p)):
                self.longer.setdefault(p[:k], []).append(p)
        self.rank = {p: k for k, p in enumerate(sorted(self.scores, key=lambda p: (-self.scores[p], p)))}
        alike = Counter(self.scores.values())
        self.tied = set("".join(p for p, score in self.scores.items() if alike[score] > 1))
        self.halves: dict[str, tuple[str, str]] = {}
        self.alone: dict[str, bool] = {}
        self.rounds = self.closures = 0
        self.base: tuple | None = None
        self.clear()

    def vocabulary(self) -> tuple:
        """The machine of all pieces as words: states, and the entries of the table that are compiled."""
        words = sorted({p.strip(BAR) for p in self.scores})
        self.count([w.encode() for w in words if w])
        at = np.flatnonzero(self.table >= 0)
        return self.states, at, self.table[at]

    def restore(self, base: tuple) -> None:
        """Begin from what ``vocabulary`` gave."""
        self.base = base
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.views: dict[tuple[str, str], str] = {}
        self.alike: dict[tuple, str] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full(256 * 1024, -1, dtype=np.int32)
        self.final = np.zeros(1024, dtype=np.int32)
        self.start = self._id(("", (None,), (0,), b""))
        if self.base is not None:
            states, at, values = self.base
            for state in states:
                self._id(state)
            self.table[at] = values

    def _id(self, state: tuple) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.final):
                more = min(len(self.final), 32768)
                self.table = np.append(self.table, np.full(more * 256, -1, dtype=np.int32))
                self.final = np.append(self.final, np.zeros(more, dtype=np.int32))
            self.final[k] = state[2][-1]
        return k

    # the segmentation of short strings

    def _bpe(self, text: str) -> list[str]:
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                if (s := scores.get(parts[i] + parts[i + 1])) is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            merged = parts[at] + parts[at + 1]
            self.halves[merged] = parts[at], parts[at + 1]
            parts[at : at + 2] = [merged]
        return parts

    def _stable(self, token: str) -> bool:
        if (ok := self.alone.get(token)) is None:
            ok = self.alone[token] = self._bpe(token) == [token]
        return ok

    def _fits(self, before: str | None, token: str) -> bool:
        """Whether the segmentation of the two as one string is these two."""
        if before is None:
            return self._stable(token)
        if (ok := self.pairs.get((before, token))) is None:
            ok = self.pairs[before, token] = self._stable(token) and self._stable(before) and self._apart(before, token)
        return ok

    def _apart(self, a: str, b: str) -> bool:
        """Undo the merges that made both tokens, the latest first: at no time did what lay at both sides of the boundary
        merge. Equal merges go from left to right; where pieces of equal scores meet, the string is segmented."""
        if a[-1] in self.tied and b[0] in self.tied:
            return self._bpe(a + b) == [a, b]
        rank, halves, until = self.rank, self.halves, len(self.rank)
        while True:
            if rank.get(a + b, until) < until:
                return False
            left = rank[a] if len(a) > 1 else -1
            right = rank[b] if len(b) > 1 else -1
            if left < 0 and right < 0:
                return True
            if left > right:
                until, a = left, halves[a][1]
            else:
                until, b = right + 1, halves[b][0]

    # transitions

    def _char(self, window: str, last: tuple, count: tuple, c: str) -> tuple[tuple, int]:
        """The state after one character, and the tokens emitted."""
        if c == " ":
            c = BAR
        emitted = 0
        if c not in self.scores:
            return ("", (None,), (0,), b""), count[-1] + len(c.encode("utf-8"))
        if c == BAR and not window.endswith(BAR):
            emitted, window, last, count = count[-1], "", (None,), (0,)
        full = window + c
        for at in range(len(full)):
            token = full[at:]
            if last[at] != "" and token in self.scores and self._fits(last[at], token):
                break
        else:
            raise AssertionError(f"no segmentation ends with {c!r}")
        last, count = (*last, token), (*count, count[at] + 1)
        last = tuple(self._view(x, full[i:]) for i, x in enumerate(last))
        low = next(i for i, x in enumerate(last) if x != "")
        least = min(n for n, x in zip(count, last, strict=True) if x != "")
        count = tuple(n - least if x != "" else 0 for n, x in zip(count, last, strict=True))
        return (full[low:], last[low:], count[low:], b""), emitted + least

    def _view(self, last: str | None, tail: str) -> str | None:
        """What a last token means to the pieces that begin with ``tail`` and go on: "" if none can follow it."""
        if tail == "" or last == "":
            return last
        more = self.longer.get(tail)
        if more is None or last is None:
            return "" if more is None else last
        if (view := self.views.get((last, tail))) is None:
            if len(more) > FEW:
                view = last
            else:
                fit = tuple(p for p in more if self._fits(last, p))
                view = self.alike.setdefault((tail, fit), last) if fit else ""
            self.views[last, tail] = view
        return view

    def compile(self, state: int, byte: int) -> None:
        window, last, count, part = self.states[state]
        part += bytes([byte])
        lead = part[0]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(part) < size:
            nxt, emitted = (window, last, count, part), 0
        else:
            nxt, emitted = self._char(window, last, count, part.decode("utf-8", "surrogatepass"))
        if emitted > 63:
            raise AssertionError("more tokens than a transition holds")
        self.table[state * 256 + byte] = self._id(nxt) * 64 + emitted

    # runs

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States out and tokens emitted of the chunks [begin, end) of ``data``, each from its own state."""
        order = np.argsort(begin - end, kind="stable")
        at, size, state = begin[order], (end - begin)[order], state[order].astype(np.int64)
        count = np.zeros(len(at), dtype=np.int64)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            key = state[:n] * 256 + data[at[:n] + step]
            got = self.table[key]
            if (got < 0).any():
                for k in np.unique(key[got < 0]).tolist():
                    self.compile(k >> 8, k & 255)
                got = self.table[key]
            state[:n] = got >> 6
            count[:n] += got & 63
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Token counts of UTF-8 texts, none of them empty."""
        if len(self.states) > STATES or len(self.pairs) > 8 * STATES:
            self.clear()
        data = np.frombuffer(b" " + b" ".join(texts), dtype=np.uint8)  # the space before each text is the dummy prefix
        head = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        space = data == 32
        synced = np.flatnonzero(space[1:] & ~space[:-1] & (data[:-1] != BAR.encode()[-1])) + 1
        begin, known = cut_points(synced, head[:-1], data)
        chunk, link, out, tokens = self.maps(data, begin, known)
        tokens = self.compose(link, tokens + np.where(link < 0, self.final[out], 0))
        firsts = known[chunk]  # the one entry of each chunk whose state is known: its tokens go up to the next such chunk
        return np.add.reduceat(tokens[firsts], np.searchsorted(begin[chunk[firsts]], head[:-1]))

    def maps(self, data: np.ndarray, begin: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """The maps of all chunks as one table of entries: (chunk, entry of the next chunk that it leads to, or -1 where
        the next state is known, state out, tokens)."""
        end, open_ = np.append(begin[1:], len(data)), np.append(~known[1:], False)
        rest, heads = np.flatnonzero(~known), np.flatnonzero(known)
        keys = heads << 32 | self.start
        if len(rest):
            since = begin[heads[np.searchsorted(heads, rest) - 1]]  # no run begins before a known state
            for k in range(STARTS):
                first = np.minimum(whole(data, np.maximum(begin[rest] - BACK - k, since)), begin[rest])
                states = np.full(len(rest), self.start, dtype=np.int64)
                keys = np.append(keys, rest << 32 | self.run(data, first, begin[rest], states)[0])
        new = keys = np.unique(keys)
        out = tokens = np.zeros(0, np.int64)
        done, self.closures = new[:0], 0
        while len(new):
            chunk = new >> 32
            got = self.run(data, begin[chunk], end[chunk], new & 0xFFFFFFFF)
            order = np.argsort(np.append(done, new), kind="stable")
            done, out, tokens = np.append(done, new)[order], np.append(out, got[0])[order], np.append(tokens, got[1])[order]
            goes = open_[chunk]
            new = np.setdiff1d((chunk[goes] + 1) << 32 | got[0][goes], done)
            self.closures += 1
        chunk = done >> 32
        link = np.where(open_[chunk], np.searchsorted(done, (chunk + 1) << 32 | out), -1)
        return chunk, link, out, tokens

    def compose(self, link: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The tokens of each entry's chunk and all those it leads to."""
        self.rounds = 0
        while len(on := np.flatnonzero(link >= 0)):
            to = link[on]
            tokens, link = tokens.copy(), link.copy()
            tokens[on], link[on] = tokens[on] + tokens[to], link[to]
            self.rounds += 1
        return tokens


def whole(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at``, moved on to where a character begins."""
    for _ in range(3):
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return at


def cut_points(synced: np.ndarray, heads: np.ndarray, data: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and whether the state is known there: at each text's head, at the first synced position of
    each ``chunk`` bytes, and at every ``chunk`` bytes of a stretch longer than twice that without one."""
    first = synced[np.unique(synced // chunk, return_index=True)[1]]
    known = np.union1d(heads, first)
    gap = np.diff(np.append(known, len(data)))
    wide = np.flatnonzero(gap > 2 * chunk)
    more = [np.arange(known[i] + chunk, known[i] + gap[i] - chunk // 2, chunk) for i in wide.tolist()]
    begin = np.union1d(known, whole(data, np.concatenate(more))) if more else known
    return begin, np.isin(begin, known)


COMPILED: dict[str, tuple] = {}


def compiled(model: str) -> tuple:
    """The machine of a model's vocabulary, made once by the driver."""
    if model not in COMPILED:
        COMPILED[model] = Transducer(model).vocabulary()
    return COMPILED[model]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled(model))

    def make() -> Transducer:
        machine = Transducer(model)
        machine.restore(sent.value)
        return machine

    def run(batches):
        machine = kept(f"transducer:{model}", make)
        for b in parts(batches, 1, 2000, GROUP):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            n = np.zeros(len(texts), np.int64)
            some = np.flatnonzero(size)
            if len(some):
                n[some] = machine.count([texts[i] for i in some.tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5(docs: DataFrame, model: str) -> DataFrame:
    return count_tokens(docs, model)
