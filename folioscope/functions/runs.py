"""Digests and minimum-hash bands of sets of 64-bit values, worked out on whole Arrow batches.

The hashes are those of Spark's ``xxhash64``, so a band made here equals one made
by Spark's own expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
SLICE = 1 << 16  # values that are worked on at once; a larger set alone
_P1, _P2, _P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_P4, _P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << U64(bits)) | (h >> U64(64 - bits))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def hash_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of bigint values (as unsigned ones)."""
    h = (seed + _P5 + U64(8)) ^ (_turned(values * _P2, 31) * _P1)
    return _ended(_turned(h, 27) * _P1 + _P4)


def hash_int(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of int values that are not negative."""
    h = (seed + _P5 + U64(4)) ^ (values.astype(U64) * _P1)
    return _ended(_turned(h, 23) * _P2 + _P3)


def band_hashes(values: np.ndarray, at: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A row of ``bands`` hashes for each set; ``at`` is where the sets begin, and the end; none is empty.

    A band hashes ``rows`` minimum hashes; one 64-bit hash of a value gives two of 31 bits.
    """
    n = rows * bands
    base = hash_long(values, np.full(1, 42, U64))
    minima = np.zeros((n + n % 2, len(at) - 1), U64)
    for i in range(0, n, 2):
        h = hash_int(np.full(1, i // 2, U64), base)
        minima[i] = np.minimum.reduceat((h & U64(0x7FFFFFFF)).astype(np.uint32), at[:-1])
        minima[i + 1] = np.minimum.reduceat((h >> U64(33)).astype(np.uint32), at[:-1])
    out = np.zeros((len(at) - 1, bands), U64)
    for b in range(bands):
        key = hash_int(np.full(1, b, U64), np.full(len(at) - 1, 42, U64))
        for row in minima[b * rows : (b + 1) * rows]:
            key = hash_int(row, key)
        out[:, b] = key
    return out


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        yield first, last
        first = last


def _signed(heads: pa.Array, values: np.ndarray, at: np.ndarray, rows: int, bands: int) -> pa.Array:
    size = np.diff(at)
    order = np.lexsort((values, np.repeat(np.arange(len(size)), size)))
    texts = pa.array(values[order]).cast(pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts), ",")
    digests = [
        hashlib.sha256((head + tail).encode()).hexdigest() if n else None
        for head, tail, n in zip(heads.to_pylist(), joined.to_pylist(), size.tolist(), strict=True)
    ]
    full = size > 0
    keys = band_hashes(values.view(U64), np.append(at[:-1][full], at[-1]), rows, bands) if full.any() else np.zeros(0, U64)
    of_keys = np.concatenate([[0], np.cumsum(bands * full)])
    return pa.StructArray.from_arrays([
        pa.array(digests, pa.string()),
        pa.ListArray.from_arrays(pa.array(of_keys, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
    ], ["digest", "bands"])


def signed(head: Column, items: Column, rows: int, bands: int) -> Column:
    """Of a set ``items`` of bigint: ``digest``, the SHA-256 of ``head`` and the sorted items with
    commas between, and ``bands``, hashes of ``rows`` minimum hashes each. An empty set has
    no digest and no bands."""

    @F.arrow_udf("struct<digest:string,bands:array<bigint>>")
    def run(heads: pa.Array, sets: pa.Array) -> pa.Array:
        at = sets.offsets.to_numpy()
        values = sets.values.to_numpy(zero_copy_only=False)
        parts = [
            _signed(heads.slice(a, b - a), values[at[a] : at[b]], at[a : b + 1] - at[a], rows, bands) for a, b in _slices(at)
        ]
        return pa.concat_arrays(parts) if parts else _signed(heads, values[:0], np.zeros(1, np.int64), rows, bands)

    return run(head, items)


def counted_bins(counts: DataFrame, n_bins: int) -> np.ndarray:
    """``counts(bin, n)`` as an array; the bins are a fixed number, so it is small at every size."""
    table = counts.select(F.col("bin").cast("int"), F.col("n").cast("bigint")).toArrow()
    out = np.zeros(n_bins, np.int64)
    out[table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return out


def _rarest(values: np.ndarray, at: np.ndarray, counts: np.ndarray, top: int, base: int) -> pa.Array:
    size = np.diff(at)
    of_set = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, counts[values & (len(counts) - 1)], of_set))
    first = np.where(size > 0, size - -(-top * size // base) + 1, 0)
    kept = np.arange(len(values)) - np.repeat(at[:-1], size) < np.repeat(first, size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(values[order][kept]))


def rarest(items: Column, counts: np.ndarray, top: int, base: int) -> Column:
    """Of a set ``items`` of bigint the first ones in order of the count of their bin, then value.

    Two sets whose Jaccard similarity is ``top / base`` or more share one of these:
    of n items they share at least n * top / base, so a common one is among the
    first of n - n * top / base + 1. The last bits of an item are its bin; the
    number of bins is a power of two.
    """

    @F.arrow_udf("array<bigint>")
    def run(sets: pa.Array) -> pa.Array:
        at = sets.offsets.to_numpy()
        values = sets.values.to_numpy(zero_copy_only=False)
        parts = [_rarest(values[at[a] : at[b]], at[a : b + 1] - at[a], counts, top, base) for a, b in _slices(at)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return run(items)
