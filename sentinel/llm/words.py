"""Words, word hashes and rolling hashes of Arrow text columns, as whole-array numpy steps.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
These are ASCII, so splitting UTF-8 bytes splits characters exactly. A word's hash is 64 bits of BLAKE2, a
window's a polynomial of its words' hashes modulo the prime 2**61 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; several arrays of 8 bytes per text byte live meanwhile.
SLICE_BYTES = 1_500_000

PRIME = (1 << 61) - 1
#: A fixed, randomly drawn number below the prime.
BASE = 0x1AC3F0B94D27E615
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of factors below it, from halves of 30 and 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    # 2**61 is 1 modulo the prime
    carried = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _reduced(np.uint64(2) * a1 * b1 + carried + a0 * b0)


class Powers:
    """Powers of a base and of its inverse modulo the prime, grown by doubling."""

    def __init__(self, base: int):
        self.bases = [base, pow(base, -1, PRIME)]
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def to(self, n: int) -> list[np.ndarray]:
        while len(self.known[0]) < n:
            have = len(self.known[0])
            self.known = [np.concatenate([k, times(k, np.uint64(pow(b, have, PRIME)))]) for k, b in zip(self.known, self.bases, strict=True)]
        return [k[:n] for k in self.known]


_POWERS = Powers(BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some rows: their hashes, the row of each, and for each row where its words begin."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 offsets into hashes

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hash of every run of `width` words of one row, and the index of its first word."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = rolling(self.hashes, width)
        at = np.flatnonzero(self.row[: n - width + 1] == self.row[width - 1:])
        return rolled[at], at


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of `width` values, from one running sum modulo the prime."""
    up, down = _POWERS.to(len(values) + 1)
    terms = times(_reduced(values), up[: len(values)])
    low, high = np.uint64((1 << 32) - 1), np.uint64(32)
    # halves add up without overflow; 2**32 times the high ones is brought below the prime by `times`
    sums = np.zeros(len(values) + 1, np.uint64)
    top = _reduced(np.cumsum(terms >> high, dtype=np.uint64))
    sums[1:] = _reduced(times(top, np.uint64(1 << 32)) + _reduced(np.cumsum(terms & low, dtype=np.uint64)))
    n = len(values) - width + 1
    return mix(times(_reduced(sums[width:] + np.uint64(PRIME) - sums[:n]), down[:n]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo, done = 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each row; a null row has none. `lower` maps A-Z to a-z first."""
    rows = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + rows + 1]
    begin, end = (int(offsets[0]), int(offsets[-1])) if rows else (0, 0)
    if begin == end:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64))
    raw = np.frombuffer(data, np.uint8, end - begin, begin)
    offsets = offsets - begin
    raw = _LOWER[raw] if lower else raw
    inside = ~_SEPARATOR[raw]
    # a word begins where the byte before is a separator or belongs to another row
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    letters = raw[inside]
    cuts = np.append((np.cumsum(inside) - 1)[starts], len(letters))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
    coded = found.dictionary_encode()
    kinds = b"".join(blake2b(w, digest_size=8).digest() for w in coded.dictionary.to_pylist())
    hashes = np.frombuffer(kinds, np.uint64)[coded.indices.to_numpy()]
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(hashes, row, first)
