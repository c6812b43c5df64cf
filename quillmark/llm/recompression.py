"""Recompression: a run-length grammar of a sequence, and longest common extensions on it.

Rounds of block compression (``aaa`` becomes one symbol) and pair compression
(``ab`` becomes one symbol, where ``a`` is on the left side of a partition of
the symbols and ``b`` on the right) shrink the sequence to one symbol. Both are
locally consistent: whether a symbol opens a group depends only on it and its
left neighbour, so equal stretches are grouped alike but for their ends. Two
positions are extended by climbing while their groups agree and descending
where they part: a few steps a round, whatever the length.
"""

from __future__ import annotations

import numpy as np

from quillmark.llm.batches import mix64


class Round:
    """One sequence of symbols and the groups that the next sequence has."""

    def __init__(self, sym: np.ndarray, first: np.ndarray, block: bool):
        n = len(sym)
        self.sym, self.first, self.block = sym, first, block
        self.last = np.append(first[1:], True)
        self.up = (np.cumsum(first) - 1).astype(np.int32)
        at = np.flatnonzero(first)
        self.start = np.append(at, n).astype(np.int32)

    def grouped(self) -> np.ndarray:
        """The next sequence: equal numbers are equal groups."""
        at, size = self.start[:-1], np.diff(self.start)
        second = size if self.block else np.where(size > 1, self.sym[np.minimum(at + 1, len(self.sym) - 1)] + 1, 0)
        key = self.sym[at].astype(np.int64) << 32 | second.astype(np.int64)
        return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _pairs(sym: np.ndarray, seed: int) -> np.ndarray:
    """Where groups start after a round of pair compression (no two neighbours are equal)."""
    side = mix64(sym.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63) == 0
    ab, ba = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
    if not (ab.any() or ba.any()):
        side = sym == sym[0]
        ab = side[:-1] & ~side[1:]
    return np.append(True, ~(ab if ab.sum() >= ba.sum() else ba))


class Grammar:
    """The rounds of a sequence of numbers from 0 on (below 2**31).

    Extensions are asked for two different places; they must end inside the
    sequence, so the caller puts symbols that occur once around each part.
    """

    def __init__(self, seq: np.ndarray):
        self.rounds: list[Round] = []
        sym, seed = seq.astype(np.int32), 0
        while len(sym) > 1:
            first = np.append(True, sym[1:] != sym[:-1])
            if not first.all():
                self.rounds.append(Round(sym, first, True))
                sym = self.rounds[-1].grouped()
            if len(sym) > 1:
                seed += 1
                self.rounds.append(Round(sym, _pairs(sym, seed), False))
                sym = self.rounds[-1].grouped()

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` on are equal (``back``: up to and with them, leftwards)."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        height = np.zeros(len(a), np.int16)
        live = np.arange(len(a))
        for level, r in enumerate(self.rounds):
            if not len(live):
                break
            edge = r.last if back else r.first
            parted = self._match(r, a, b, live, edge, back)
            height[parted] = level
            live = live[edge[a[live]] & edge[b[live]]]
            a[live], b[live] = r.up[a[live]], r.up[b[live]]
        for level in range(int(height.max(initial=0)) - 1, -1, -1):
            r = self.rounds[level]
            down = np.flatnonzero(height > level)
            for x in (a, b):
                x[down] = r.start[x[down] + 1] - 1 if back else r.start[x[down]]
            self._match(r, a, b, down, None, back)
        return i - a if back else a - i

    @staticmethod
    def _match(r: Round, a: np.ndarray, b: np.ndarray, live: np.ndarray, edge: np.ndarray | None,
               back: bool) -> np.ndarray:
        """Move ``a`` and ``b`` over equal symbols, with ``edge`` only until both
        open a group; returns those that met different symbols."""
        parted = []
        while len(live):
            if edge is not None:
                live = live[~(edge[a[live]] & edge[b[live]])]
            same = r.sym[a[live]] == r.sym[b[live]]
            parted.append(live[~same])
            live = live[same]
            x, y = a[live], b[live]
            step = 1
            if r.block:
                if back:
                    step = np.minimum(x - r.start[r.up[x]], y - r.start[r.up[y]]) + 1
                else:
                    step = np.minimum(r.start[r.up[x] + 1] - x, r.start[r.up[y] + 1] - y)
            a[live], b[live] = (x - step, y - step) if back else (x + step, y + step)
        return np.concatenate(parted) if parted else np.zeros(0, np.int64)
