"""Hashes of a text's shingles, and the fingerprint that they vote for."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42
BLOCK = 1 << 15


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included: words A-Z lower-cased, split at white space; fewer words than a shingle has give
    one, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    end = np.cumsum(size + 1) - 1
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(found: np.ndarray) -> int:
    """The unsigned number of which a bit is 1 if it is set in over half of ``found``; of none, zero."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), BLOCK):
        counts += np.unpackbits(found[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])
