"""Words of whole Arrow batches in numpy: spans, 64-bit hashes and windows, without a Python loop over words.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never uses these bytes inside a longer character, so bytes
give the same words as characters do. A null text has no words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for words of letters and digits only: all of ASCII that is neither.
ALNUM_GAPS = np.zeros(256, np.bool_)
ALNUM_GAPS[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1), kept for the next batch; a longer text makes them anew."""
    if base not in _POWERS or n > len(_POWERS[base]):
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out, out=out)
    return _POWERS[base][:n]


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null rows are empty. ``lower`` folds A-Z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), offsets - offsets[0]


class Words:
    """Words of a batch of texts: ``start``/``end`` byte positions, ``doc`` row numbers and, when asked for, hashes."""

    def __init__(self, column: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE):
        self.raw, self.offsets = text_bytes(column, lower)
        self.n_docs = len(self.offsets) - 1
        inside = ~gaps[self.raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        starts[first] |= inside[first]  # a row begins a word whatever stands before it in the buffer
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = first_end = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        ends[first_end] |= inside[last]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.counts = np.diff(np.searchsorted(self.start, self.offsets))
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash per word that depends on its bytes only."""
        if self._hash is None:
            n = len(self.raw)
            prefix = np.zeros(n + 1, np.uint64)
            terms = prefix[1:]
            np.add(self.raw, np.uint64(1), out=terms)
            terms *= _powers(_BASE, n)
            np.cumsum(terms, out=terms)
            value = (prefix[self.end] - prefix[self.start]) * _powers(_INVERSE, n + 1)[self.start]
            self._hash = mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return self._hash

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]].tobytes()

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start word numbers and hashes of all ``size``-word windows that lie within one text."""
        h = self.hash if hashes is None else hashes
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = (total ^ h[k:k + n]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1)
            total ^= total >> np.uint64(29)
        ok = np.flatnonzero(self.doc[:n] == self.doc[size - 1:size - 1 + n])
        return ok, mix(total[ok])


def release_memory() -> None:
    """Hands freed memory back to the system. Workers live through many stages and would else keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(column: pa.Array, target: int = 1_000_000):
    """Slices of a column of about ``target`` bytes each, a longer text alone: bounds the memory of vectorised work."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > target:
            yield start, i
            start, held = i, 0
        held += int(s)
    if start < len(sizes):
        yield start, len(sizes)
