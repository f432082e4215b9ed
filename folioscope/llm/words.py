"""Words of whole Arrow text columns as numpy arrays: spans and 64-bit hashes.

The texts of a batch lie behind each other in one UTF-8 buffer. Word borders are
found on the bytes of all texts at once. The hash of any byte range comes from
one prefix sum: with H(i) = sum of (byte + 1) * P**k over k < i, the range a..b has
the hash (H(b) - H(a)) * P**-a, all modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
# Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 19

_ALL = np.arange(256)
BLANK = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
NOT_BLANK = ~BLANK
DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
LETTER = UPPER | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LETTER_DIGIT = LETTER | DIGIT
LOWER = np.where(UPPER, _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _P, U64)
        down = np.full(n, _P_INV, U64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n; those for texts up to the usual size of a slice are kept."""
    usual = SLICE + (1 << 17)
    up, down = _powers(usual) if n <= usual else _powers.__wrapped__(n)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(value + 1) * P**i``, one longer than ``values``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values))[0], out=out[1:])
    return out


def ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start..end of the sequence behind ``h``."""
    return mixed((h[end] - h[start]) * powers(len(h))[1][start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``size`` bytes, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(first, last - first)
            first = last
    release()


def release() -> None:
    """Give freed memory back at the end of a task, since workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """Words of a batch: ``start``, ``end`` (bytes), ``doc`` and, on demand, hashes."""

    def __init__(self, column: pa.Array, kind: np.ndarray, fold: np.ndarray = SAME):
        raw, at = buffers(column)
        self.raw, self.at, self.n_docs = raw, at, len(column)
        self.data = fold[raw] if fold is not SAME else raw
        inside = kind[self.data]
        self.inside = inside
        full = at[:-1][at[:-1] < at[1:]]  # where texts with bytes begin
        begins = np.ones(len(raw), bool)
        begins[1:] = ~inside[:-1]
        begins[full] = True
        ends = np.ones(len(raw), bool)
        ends[:-1] = ~inside[1:]
        ends[at[1:][at[:-1] < at[1:]] - 1] = True
        self.start = np.flatnonzero(inside & begins)
        self.end = np.flatnonzero(inside & ends) + 1
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])

    def hashes(self) -> np.ndarray:
        self.h = prefix(self.data)
        return ranges(self.h, self.start, self.end)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``n`` words inside one document."""
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        first = np.flatnonzero(self.doc[: len(hashes) - n + 1] == self.doc[n - 1 :])
        return first, ranges(prefix(hashes), first, first + n)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
