"""Front-coded sorted runs of strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations


def decode_run(lcps: list[int], ends: list[int], rest: bytes) -> list[bytes]:
    """The strings of a run from their common prefixes with the string before and what follows."""
    out, last, at = [], b"", 0
    for lcp, end in zip(lcps, ends, strict=True):
        last = last[:lcp] + rest[at:end]
        out.append(last)
        at = end
    return out


def first_difference(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(x), len(y))
    while at < n:
        p, q = x[at:at + 16], y[at:at + 16]
        if p != q:
            for i in range(min(len(p), len(q))):
                if p[i] != q[i]:
                    return at + i
            return n
        at += 16
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted order of all strings as (run, position), and each one's common
    prefix with the one before.

    Every loser on the winner's path holds its common prefix with that winner,
    and a run holds the prefix of its next string with the one just taken. Of
    two strings, the one that shares more with the last taken is the smaller;
    only where they share equally much are characters compared, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    lcps = [r[1] for r in runs]
    at = [0] * size
    head = [s[0] if s else None for s in strings]
    common = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        d = first_difference(x, y, common[a])
        if d == len(x) or (d < len(y) and x[d] < y[d]):
            common[b] = d
            return a, b
        common[a] = d
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    order, prefix = [], []
    win = build(1) if size > 1 else 0
    while head[win] is not None:
        order.append((win, at[win]))
        prefix.append(common[win])
        at[win] += 1
        run = strings[win]
        if at[win] < len(run):
            head[win], common[win] = run[at[win]], lcps[win][at[win]]
        else:
            head[win] = None
        node = (win + size) >> 1
        while node:
            win, loser[node] = play(win, loser[node])
            node >>= 1
    return order, prefix
