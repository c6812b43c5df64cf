"""Counts of shared n-grams and aligned tokens over Arrow batches, in numpy.

Used by the metrics that are functions of one pair's two texts. A batch's
tokens become numbers (equal numbers for equal tokens), and all pairs of the
batch are counted at once: no Python object is made per token or n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Items counted at once (a longer pair is counted alone).
CHUNK_ITEMS = 1 << 20

#: Bytes of a word (``tx.tok``, of lower-cased text); those of other characters are none.
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens (``tx.tok``) of lower-cased texts as numbers, the offsets of the
    texts among them, and the distinct tokens. No row may be null."""
    texts = texts.cast(pa.string())
    offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    word = _WORD[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    begin[first] = word[first]   # a text's first token, whatever stands before the text
    starts = np.flatnonzero(begin)
    kept = raw[word]
    ends = np.append(np.flatnonzero(begin[word]), len(kept)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    return tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offs), tokens.dictionary


def list_codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per list column its items as numbers, shared by all columns, and the
    offsets of its rows (null rows: empty)."""
    parts = []
    for col in columns:
        if col.null_count:
            col = pa.array([x if x is not None else [] for x in col.to_pylist()], col.type)
        parts.append((col.flatten(), np.asarray(col.offsets, np.int64) - col.offsets[0].as_py()))
    whole = pa.concat_arrays([p[0] for p in parts]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut = np.cumsum([0] + [len(p[0]) for p in parts])
    return [(whole[a:b].astype(np.int64), offs) for a, b, (_, offs) in zip(cut, cut[1:], parts, strict=False)]


def char_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column without null rows, and the rows' offsets."""
    texts = col.to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _chunks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [lo, hi) in runs of about ``CHUNK_ITEMS`` items of both sides."""
    both = a + b
    lo, n = 0, len(a) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(both, both[lo] + CHUNK_ITEMS, side="right")) - 1)
        yield lo, hi
        lo = hi


def clipped_matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Per row and n = 1..order: the sum over n-grams of the smaller of their
    counts on the two sides (codes and offsets each).

    An n-gram can only match where both (n-1)-grams in it do, so each order
    looks at what is left of the one before.
    """
    (ca, oa), (cb, ob) = a, b
    out = np.zeros((len(oa) - 1, order), np.int64)
    for lo, hi in _chunks(oa, ob):
        rows = hi - lo
        code = np.concatenate([ca[oa[lo]:oa[hi]], cb[ob[lo]:ob[hi]]])
        row = np.repeat(np.tile(np.arange(rows), 2), np.append(np.diff(oa[lo:hi + 1]), np.diff(ob[lo:hi + 1])))
        second = np.arange(len(code)) >= oa[hi] - oa[lo]
        section = row + rows * second
        at, of, part = np.arange(len(code)), np.arange(rows), row
        for n in range(order):
            if not len(at):
                break
            # An n-gram of a row: the (n-1)-gram of a row in it (``part``) and its last item.
            gram, key = pd.factorize(part << 32 | code[at + n])
            of = of[key >> 32]
            in_b = second[at]
            least = np.minimum(np.bincount(gram[~in_b], minlength=len(key)),
                               np.bincount(gram[in_b], minlength=len(key)))
            out[lo:hi, n] = np.bincount(of, weights=least, minlength=rows).astype(np.int64)
            ok = np.zeros(len(code) + 1, bool)
            ok[at[least[gram] > 0]] = True
            keep = ok[at] & ok[at + 1] & (section[at] == section[np.minimum(at + n + 1, len(code) - 1)])
            keep &= at + n + 1 < len(code)
            at, part = at[keep], gram[keep]
    return out


def _byte_offsets(texts: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)


def text_matches(a: pa.Array, b: pa.Array, order: int) -> np.ndarray:
    """Per row of two columns of lower-cased texts: the tokens (``tx.tok``) of either and
    their :func:`clipped_matches` for n = 1..order. No row may be null."""
    out = np.zeros((len(a), 2 + order), np.int64)
    for lo, hi in _chunks(_byte_offsets(a), _byte_offsets(b)):
        rows = hi - lo
        code, offs, _ = word_codes(pa.concat_arrays([a.slice(lo, rows), b.slice(lo, rows)]))
        offs_a, offs_b = offs[:rows + 1], offs[rows:]
        out[lo:hi, 0], out[lo:hi, 1] = np.diff(offs_a), np.diff(offs_b)
        out[lo:hi, 2:] = clipped_matches((code, offs_a), (code, offs_b), order)
    return out


def ngram_kinds(texts: pa.Array, order: int) -> np.ndarray:
    """Per lower-cased text: its n-grams of ``order`` tokens (``tx.tok``) and how many of
    them are distinct. No row may be null."""
    out = np.zeros((len(texts), 2), np.int64)
    whole = _byte_offsets(texts)
    for lo, hi in _chunks(whole, np.zeros_like(whole)):
        code, offs, _ = word_codes(texts.slice(lo, hi - lo))
        n = np.maximum(np.diff(offs) - (order - 1), 0)
        gram = row = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(row)) + np.repeat(offs[:-1] - (np.cumsum(n) - n), n)
        # An n-gram of a text: the text, then its tokens one by one.
        for i in range(order):
            gram, key = pd.factorize(gram << 32 | code[at + i])
        of = np.zeros(len(key), np.int64)
        of[gram] = row
        out[lo:hi, 0], out[lo:hi, 1] = n, np.bincount(of, minlength=hi - lo)
    return out


def best_clipped_matches(side: np.ndarray, lists: np.ndarray, tokens: tuple[np.ndarray, np.ndarray],
                         order: int) -> np.ndarray:
    """Per row and n = 1..order: the sum over n-grams of the smaller of their count in
    the lists of side -1 and their largest count in those of one side from 0 on.

    Row r has the lists ``lists[r]`` to ``lists[r + 1]``, of the sides ``side``;
    ``tokens`` are the codes and the offsets of the lists. Lists of one row and side
    are counted together; no n-gram runs over the end of a list.
    """
    code, offs = tokens
    out = np.zeros((len(lists) - 1, order), np.int64)
    whole = offs[lists]
    sides, rank = np.unique(side, return_inverse=True)
    group = np.repeat(np.arange(len(lists) - 1), np.diff(lists)) * len(sides) + rank
    for lo, hi in _chunks(whole, np.zeros_like(whole)):
        first, last = lists[lo], lists[hi]
        c = code[whole[lo]:whole[hi]]
        section = np.repeat(np.arange(first, last), np.diff(offs[first:last + 1]))
        own = group[section] - lo * len(sides)
        at, gram = np.arange(len(c)), c
        for n in range(order):
            if not len(at):
                break
            if n:
                gram = np.unique(gram << 32 | c[at + n], return_inverse=True)[1]
            key, count = np.unique(own[at] << 32 | gram, return_counts=True)
            of = sides[(key >> 32) % len(sides)]
            key, inverse = np.unique((key >> 32) // len(sides) << 32 | key & 0xFFFFFFFF, return_inverse=True)
            most = np.zeros((2, len(key)), np.int64)
            for row, found in enumerate((of == -1, of >= 0)):
                np.maximum.at(most[row], inverse[found], count[found])
            out[lo:hi, n] = np.bincount(key >> 32, weights=most.min(axis=0), minlength=hi - lo).astype(np.int64)
            keep = at + n + 1 < len(c)
            at, gram = at[keep], gram[keep]
            keep = section[at] == section[at + n + 1]
            at, gram = at[keep], gram[keep]
    return out


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matches and chunks per row, where a token's k-th occurrence from the end
    on one side is matched with its k-th from the end on the other; a chunk is
    a run of matches that follow each other on both sides."""
    (ca, oa), (cb, ob) = a, b
    parts = [_aligned((ca[oa[lo]:oa[hi]], oa[lo:hi + 1] - oa[lo]), (cb[ob[lo]:ob[hi]], ob[lo:hi + 1] - ob[lo]))
             for lo, hi in _chunks(oa, ob)]
    matches, chunks = zip(*parts) if parts else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    return np.concatenate(matches), np.concatenate(chunks)


def _aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = len(a[1]) - 1
    sides = []
    for code, offs in (a, b):
        row = np.repeat(np.arange(rows), np.diff(offs))
        at = np.arange(len(code))
        order = np.lexsort((-at, code, row))
        r, c = row[order], code[order]
        new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))[:len(r)]
        first = np.flatnonzero(new)
        k = at - first[np.cumsum(new) - 1] if len(r) else at
        sides.append((r, c, k, order - offs[r]))
    (ra, ka, na, pa_), (rb, kb, nb, pb) = sides
    # Rows and tokens are numbered densely, so that a key fits one number.
    token = np.unique(np.concatenate([ra << 32 | ka, rb << 32 | kb]), return_inverse=True)[1].astype(np.int64)
    _, i, j = np.intersect1d(token[:len(ra)] << 32 | na, token[len(ra):] << 32 | nb, assume_unique=True, return_indices=True)
    order = np.lexsort((pb[j], rb[j]))
    row, g, h = rb[j][order], pa_[i][order], pb[j][order]
    joined = (row[1:] == row[:-1]) & (g[1:] - g[:-1] == 1) & (h[1:] - h[:-1] == 1)
    matches = np.bincount(row, minlength=rows)
    return matches, matches - np.bincount(row[1:][joined], minlength=rows)
