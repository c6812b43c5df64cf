"""Hashed word and character n-gram features of whole texts, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import SPACE, Texts, chunks, mix64, prefix_sums, range_hash, tidy

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KNOWN = 1 << 14
#: Kinds of code points for shapes: upper case (ASCII and Latin-1), digits, white space, other ASCII each its own.
_SHAPE = np.full(256, ord("a"), np.uint32)
_SHAPE[:128] = np.arange(128)
_SHAPE[[*range(65, 91), *range(0xC0, 0xDF)]] = ord("A")
_SHAPE[[*range(97, 123)]] = ord("a")
_SHAPE[[*range(48, 58)]] = ord("0")
_SHAPE[SPACE] = 32
_CODE = mix64(np.arange(1, _KNOWN + 1, dtype=np.uint64) * _ODD)


class Codes(Texts):
    """A chunk as code points instead of bytes; white space is code 32."""

    def __init__(self, part: Texts):
        lead = np.zeros(len(part.data) + 1, np.int64)
        np.cumsum((part.data & 0xC0) != 0x80, out=lead[1:])
        text = part.data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        super().__init__(points, lead[part.offsets], part.row)
        self.space = SPACE[np.minimum(points, 255)]

    def hashes(self) -> np.ndarray:
        """A 64-bit value per code point; all white space has one."""
        at = np.where(self.space, np.uint32(32), self.data)
        out = _CODE[np.minimum(at, _KNOWN - 1)]
        far = np.flatnonzero(at >= _KNOWN - 1)
        if len(far):
            out[far] = mix64((at[far].astype(np.uint64) + np.uint64(1)) * _ODD)
        return out

    def words(self):
        part = Texts(np.where(self.space, 32, 97).astype(np.uint8), self.offsets, self.row)
        return part.words()


def lowered(part: Texts) -> Texts:
    """The same texts with A-Z in lower case."""
    data = part.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    return Texts(data, part.offsets, part.row)


def _inside(codes: Codes, size: int, n: int) -> np.ndarray:
    """Which of the first ``size`` windows of ``n`` codes lie in one document."""
    ok = np.ones(size, bool)
    for t in range(1, n):
        at = codes.offsets[1:-1] - t
        ok[at[(at >= 0) & (at < size)]] = False
    return ok


def recency(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How long ago each word was last seen in its document: 0 never, else
    1 + the binary logarithm of the distance in words."""
    key = mix64(word + doc.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(word), np.int64)
    out[order[1:][same]] = 1 + np.log2(order[1:][same] - order[:-1][same]).astype(np.int64)
    return out


def hashed_features(part: Texts, bits: int, grams: tuple[int, ...],
                    again: int = 0, shape: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket, weight) of every feature occurrence, documents
    ascending: the words, the words' ``recency`` with weight ``again`` (0:
    none), each n-gram length, and n-grams of ``shape`` kinds of characters
    (0: none; kinds are upper, lower, digit, space, and other characters).

    An n-gram lies inside a word with the white space on either side counted
    as part of it (one code), as in ``<word>``.
    """
    codes = Codes(part)
    shift = np.uint64(64 - bits)
    h = codes.hashes()
    start, end, doc = codes.words()
    if len(start):
        word = range_hash(prefix_sums(h), start, end)
        yield doc, (word >> shift).astype(np.int64), 1
        if again:
            seen = mix64(recency(doc, word).astype(np.uint64) + np.uint64(1 << 40))
            yield doc, (seen >> shift).astype(np.int64), again
    if shape:
        size = len(h) - shape + 1
        kinds = _SHAPE[np.minimum(codes.data, 255)].astype(np.uint64)
        g = np.full(max(size, 0), np.uint64(1 << 41))
        for t in range(shape if size > 0 else 0):
            g = g * _ODD + kinds[t:t + size]
        if size > 0:
            at = np.flatnonzero(_inside(codes, size, shape))
            yield np.searchsorted(codes.offsets, at, side="right") - 1, (mix64(g[at]) >> shift).astype(np.int64), 1
    for n in grams:
        size = len(h) - n + 1
        if size <= 0:
            continue
        ok = _inside(codes, size, n)
        for t in range(1, n - 1):
            ok &= ~codes.space[t:t + size]
        ok &= ~(codes.space[:size] & codes.space[n - 1:]) if n < 3 else True
        at = np.flatnonzero(ok)
        g = np.full(size, np.uint64(n))
        for t in range(n):
            g = g * _ODD + h[t:t + size]
        yield (np.searchsorted(codes.offsets, at, side="right") - 1), (mix64(g[at]) >> shift).astype(np.int64), 1


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hash_sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` distinct ids, by a hash of the id (the same ones on every run)."""
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return rows.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(key, "doc_id").limit(n)


def sparse_sample(docs: DataFrame, ids: DataFrame, bits: int, grams: tuple[int, ...], again: int = 0,
                  lower: bool = False, shape: int = 0) -> DataFrame:
    """``doc_id, grp, buckets, counts, words`` of the sampled documents.

    ``ids`` (``doc_id, grp``) is a bounded sample, so its broadcast is bounded.
    """
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = list(hashed_features(lowered(part) if lower else part, bits, grams, again, shape))
                doc = np.concatenate([d for d, *_ in found]) if found else np.zeros(0, np.int64)
                key = np.concatenate([b for _, b, _ in found]) if found else np.zeros(0, np.int64)
                weight = np.concatenate([np.full(len(d), w) for d, _, w in found]) if found else key
                both, inverse = np.unique((doc << bits) | key, return_inverse=True)
                counts = np.bincount(inverse, weight, len(both))
                n_words = np.bincount(found[0][0], minlength=part.n) if found else np.zeros(part.n, np.int64)
                cut = np.searchsorted(both, np.arange(part.n + 1) << bits)
                key = (both & ((1 << bits) - 1)).astype(np.uint32)
                counts = counts.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, part.n), batch.column(1).slice(part.row, part.n),
                     pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                     pa.array(n_words.astype(np.int64))],
                    names=["doc_id", "grp", "buckets", "counts", "words"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "grp", "text")
    return rows.mapInArrow(tidy(featurise), "doc_id long, grp int, buckets binary, counts binary, words long")


def sparse_rows(got: pa.Table) -> list[tuple]:
    """``(group, buckets, counts, words)`` of a table of :func:`sparse_sample`, ordered by id."""
    got = got.sort_by([("doc_id", "ascending"), ("grp", "ascending")])
    # Views of the Arrow buffers: no second copy of the sample is made.
    return [(g, np.frombuffer(b.as_buffer(), np.uint32), np.frombuffer(c.as_buffer(), np.float32), n)
            for g, b, c, n in zip(got["grp"].to_pylist(), got["buckets"], got["counts"],
                                  got["words"].to_pylist(), strict=True)]


def fit_in_one_task(sample: DataFrame, fit, schema: str) -> pa.Table:
    """What ``fit`` (a function of the rows of :func:`sparse_rows`, to an Arrow
    table of ``schema``) makes of a bounded sample: it runs in one task on an
    executor, and only its result reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from fit(sparse_rows(pa.Table.from_batches(held))).to_batches()

    return sample.repartition(1).mapInArrow(tidy(run), schema).toArrow()
