"""A compressed full-text index over words: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` by the suffix that starts there. Zeros separate
    pieces; each counts as a symbol of its own, smaller than all others, so
    no comparison runs across one."""
    n = len(text)
    seps = np.flatnonzero(text == 0)
    rank = text + len(seps)
    rank[seps] = np.arange(len(seps))
    h = 1
    while True:
        key = rank.astype(np.uint64) * np.uint64(n + len(text) + 2)
        key[:-h] += (rank[h:] + 1).astype(np.uint64)
        order = np.argsort(key)
        sorted_key = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


class BitRank:
    """Bits in 64-bit words with the count before each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[:len(small)] = small
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of any symbol before any position, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, now = [], symbols
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = ((now >> bit) & 1).astype(bool)
            self.levels.append((bit, BitRank(ones), int(len(now) - ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])
        # Where a symbol's run begins after the last level.
        self.start = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks.ones(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search over a text of symbols 1.. with zeros between pieces (and at its end)."""

    def __init__(self, text: np.ndarray):
        self.order = suffix_order(text)
        size = int(text.max()) + 1
        counts = np.bincount(text, minlength=size)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(text[self.order - 1], size)

    def repeated(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns ``text[a:a + length]``, those that occur twice or
        more in the index: which, and their intervals of the suffix order.
        Patterns are streamed from their last symbol to their first and
        dropped as soon as they match one place only."""
        alive = np.arange(len(at))
        c = text[at + length - 1]
        lo, hi = self.below[c], self.below[c + 1]
        for t in range(length - 2, -1, -1):
            go = hi - lo >= 2
            alive, lo, hi = alive[go], lo[go], hi[go]
            if not len(alive):
                break
            c = text[at[alive] + t]
            lo = self.below[c] + self.wavelet.rank(c, lo)
            hi = self.below[c] + self.wavelet.rank(c, hi)
        go = hi - lo >= 2
        return alive[go], lo[go], hi[go]
