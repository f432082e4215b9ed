"""A word-level FM-index: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


class Ranks:
    """Bits with constant-time counts: a running count per 64 bits plus a popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[block] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet tree over numbers below 2**levels, one rank structure per level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1
            self.levels.append((level, Ranks(bits.astype(np.uint8))))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low = np.zeros_like(i)
        for level, ranks in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            ones, ones_low = ranks.ones(i), ranks.ones(low)
            i = np.where(one, ranks.zeros + ones, i - ones)
            low = np.where(one, ranks.zeros + ones_low, low - ones_low)
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(i)
        for level, ranks in self.levels:
            bit, ones = ranks.bit(i).astype(np.int64), ranks.ones(i)
            out |= bit << level
            i = np.where(bit == 1, ranks.zeros + ones, i - ones)
        return out


def suffix_array(text: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; each separator is a symbol of its own."""
    n = len(text)
    order = np.lexsort((np.where(separators, np.arange(n), 0), text))
    key = np.where(separators, np.arange(n) - n, text)  # below all words, by position
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    span = 1
    while rank.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        in_order = pair[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        span *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of a sequence of word numbers; 0 separates runs and begins the sequence.

    The position of every ``sample``-th word of a run, and of its first, is kept;
    others are found by walking back to one of those, which never passes a
    separator.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        separators = text == 0
        sa = suffix_array(text, separators)
        bwt = text[sa - 1]
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = Wavelet(bwt, max(1, int(n_symbols).bit_length()))
        at = np.arange(len(text))
        run = np.maximum.accumulate(np.where(separators, at, 0))
        kept = (((at - run) % sample == 1) | separators)[sa]
        self.sampled = Ranks(kept.astype(np.uint8))
        self.positions = sa[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi of every pattern; ``patterns`` is right-aligned, one row each."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, -back]
            known = symbol > 0
            lo[live[~known]] = hi[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            lo[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row's suffix in the sequence."""
        out = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            hit = self.sampled.bit(at).astype(bool)
            out[open_[hit]] = self.positions[self.sampled.ones(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.wavelet.at(at)
            at = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out
