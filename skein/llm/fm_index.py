"""An FM-index over a sequence of small integers, vectorized over queries.

The suffix array comes from prefix doubling; the Burrows-Wheeler transform is
held in a wavelet matrix whose levels answer rank by block counts and
popcounts; every ``step``-th text position is kept for locating.
"""

from __future__ import annotations

import numpy as np


class RankBits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.zeros = len(bits) - int(counts.sum())

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word, left = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << left) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[RankBits] = []
        for shift in reversed(range(max(1, int(top).bit_length()))):
            bits = ((values >> shift) & 1).astype(bool)
            self.levels.append(RankBits(bits))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i``."""
        start = np.zeros_like(i)
        for level, shift in zip(self.levels, reversed(range(len(self.levels))), strict=True):
            one = ((symbol >> shift) & 1).astype(bool)
            ones_i, ones_s = level.rank1(i), level.rank1(start)
            i = np.where(one, level.zeros + ones_i, i - ones_i)
            start = np.where(one, level.zeros + ones_s, start - ones_s)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at ``i``, its occurrences before ``i``)."""
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.get(i)
            ones_i, ones_s = level.rank1(i), level.rank1(start)
            i = np.where(one, level.zeros + ones_i, i - ones_i)
            start = np.where(one, level.zeros + ones_s, start - ones_s)
            symbol = symbol * 2 + one
        return symbol, i - start


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the last value must be the only smallest."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of ``values`` (each at least 1); symbol 0 ends the text."""

    def __init__(self, values: np.ndarray, step: int = 16):
        text = np.concatenate([values.astype(np.int64), [0]])
        self.size = len(text)
        order = suffix_array(text)
        top = int(text.max())
        self.wavelet = WaveletMatrix(text[order - 1], top)
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        sampled = order % step == 0
        self.marks = RankBits(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns (one a row, equal lengths), read from their ends."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column].astype(np.int64)
            known = symbol < len(self.first) - 2
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marks.get(at))
        while len(todo):
            symbol, before = self.wavelet.access(at[todo])
            at[todo] = self.first[symbol] + before
            steps[todo] += 1
            todo = todo[~self.marks.get(at[todo])]
        return self.samples[self.marks.rank1(at)] + steps
