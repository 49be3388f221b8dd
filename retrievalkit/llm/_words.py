"""Words, word hashes and shingles of many texts at once (numpy, in tasks).

A word is a run of bytes other than space and \\x09-\\x0D. Texts come as the
buffers of an Arrow column; work goes in chunks of about ``CHUNK`` bytes, so a
task's memory does not depend on the batch, only on its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
_pows = (np.ones(1, U64), np.ones(1, U64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse. Tables for usual
    chunks are kept, those for a longer text go when it is done."""
    global _pows
    if len(_pows[0]) >= n:
        return _pows
    n = max(n, min(2 * n, CHUNK + (CHUNK >> 3)))
    both = []
    for b in (_BASE, _INV):
        p = np.full(n, b, U64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if n <= CHUNK + (CHUNK >> 3):
        _pows = tuple(both)
    return tuple(both)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, offsets)`` of runs of whole texts of about ``size`` bytes."""
    buf, off = utf8(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """Word spans of a chunk: ``start``/``end`` byte positions and, per text,
    ``first`` (offsets into the words). ``between`` tells the bytes that are in
    no word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE):
        self.buf, self.off = buf, off
        n = len(buf)
        word = ~between[buf]
        edge = np.zeros(n + 1, bool)        # a text begins here
        edge[off] = True
        begin, stop = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1] | edge[1:n]
            stop[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z."""
        return self.span_hashes(self.start, self.end, lower)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        n = len(self.buf)
        p, inv = _powers(n + 1)
        acc = np.zeros(n + 1, U64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.buf] * p[:n], out=acc[1:])
        return mix((acc[end] - acc[start]) * inv[start])


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of each text and their offsets; a text
    of fewer words is one window, one without words has none."""
    n, count = len(words), np.diff(first)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    q = [U64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    out = np.zeros(n, U64)
    for j in range(min(k, n)):
        out[:n - j] += words[j:] * q[j]
    keep = np.zeros(n, bool)
    last = first[1:] - k                     # last window that fits
    fits = count >= k
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first[:-1][fits], 1)
    np.add.at(delta, last[fits] + 1, -1)
    keep |= np.cumsum(delta[:n]) > 0
    short = np.flatnonzero((count > 0) & ~fits)
    if len(short):
        at, size = first[short], count[short]
        acc = size.astype(U64) * U64(0xA0761D6478BD642F)
        for j in range(k):
            has = j < size
            acc[has] += words[at[has] + j] * q[j]
        out[at], keep[at] = acc, True
    offsets = np.zeros(len(first), np.int64)
    np.cumsum(np.where(fits, count - k + 1, (count > 0).astype(np.int64)), out=offsets[1:])
    return mix(out[keep]), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), out


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run, zero for an empty one."""
    acc = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=acc[1:])
    return acc[offsets[1:]] - acc[offsets[:-1]]


def run_mins(values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """Minimum of each run, ``empty`` for an empty one."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[:-1][full])
    return out
