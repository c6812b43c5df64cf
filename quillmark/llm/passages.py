"""Substring dedup over words: FM-index shards and matching windows.

A window is ``WINDOW`` consecutive words. Each window belongs to the shard of
its anchor, the word triple in it with the smallest hash, so equal windows of
any two documents meet in one shard, and consecutive windows mostly share
their anchor: a document is cut into pieces, runs of windows with one anchor.
Every shard indexes its pieces (a compressed FM-index with a wavelet matrix)
and streams the windows of all of them through backward search; a window whose
interval holds a smaller document is reported. Sharding by content instead of
by document keeps the work in proportion to the input: a document is searched
where it can match, not in every shard.

A piece that also begins, word for word, in a smaller document of the same
batch is settled there and isn't sent: thousands of copies of one passage send
a few. In a shard, a piece whose anchor is in one document only can't match.

A triple with more pieces than a task should hold is split: its windows are
dealt by their own 128-bit hash instead, and the smallest document of each is
found first in the batch, then in the shard. Which triples are that common is
counted beforehand, on some of the documents if there are many; the result is
the same whichever way a triple goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import BYTE_CODE, CHUNK_BYTES, Texts, chunks, mix64, prefix_sums, range_hash, window_hash
from quillmark.llm.blocks import group_tables, span_batches
from quillmark.llm.fmindex import FMIndex
from quillmark.llm.tables import documents, staged
from quillmark.operators.joins import sized_broadcast_join

#: Words a window, and words an anchor.
WINDOW, ANCHOR = 13, 3
#: Text bytes a shard, on average, before its pieces' overlap, and text bytes cut before they are sent.
SHARD_BYTES, SEND_BYTES = 2 << 20, 8 << 20
#: Pieces of an anchor in all documents from which its windows are dealt by their own hash,
#: and text bytes (of documents chosen by hash) in which pieces are counted.
HOT_PIECES, COUNT_BYTES = 1 << 14, 128 << 20
_TOP = np.uint64(2 ** 64 - 1)


def take_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    size = end - start
    first = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - first, size)]


def word_codes(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and 64-bit code of every word."""
    start, end, doc = part.words()
    return start, end, doc, range_hash(prefix_sums(BYTE_CODE[part.data]), start, end) if len(start) else start.astype(np.uint64)


def piece_codes(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and code of every word of texts of the given sizes, a chunk at a time."""
    offsets = np.append(0, np.cumsum(size))
    pieces, codes, lo = [], [], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
        _, _, piece, code = word_codes(Texts(text[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lo))
        pieces.append(piece + lo)
        codes.append(code)
        lo = hi
    return np.concatenate(pieces), np.concatenate(codes)


def cut(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all documents: first window, one past the last, the anchor's position and hash."""
    n = len(code) - WINDOW + 1
    at = np.flatnonzero(doc[:max(n, 0)] == doc[WINDOW - 1:]) if n > 0 else np.zeros(0, np.int64)
    if not len(at):
        return at, at, at, at.astype(np.uint64)
    gram = np.full(len(code), _TOP)
    h, where = window_hash(code, doc, ANCHOR)
    gram[where] = h
    best, anchor = gram[at], at.copy()
    for t in range(1, WINDOW - ANCHOR + 1):
        other = gram[at + t]
        less = other < best
        best = np.where(less, other, best)
        anchor[less] = at[less] + t
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + 1, anchor[first], best[first]


def hot_anchors(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes, in order, of the anchors with about ``HOT_PIECES`` pieces or more (at
    most one for each ``HOT_PIECES`` pieces there are)."""
    share = max(1, min(-(-total // COUNT_BYTES), HOT_PIECES // 32))   # a common one is met 32 times and more
    some = docs.where(F.pmod(F.xxhash64("doc_id", "rid"), F.lit(share)) == 0) if share > 1 else docs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = n > 1   # a common anchor comes again within so many bytes
            return pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(n[often])], names=["anchor", "n"])

        for batch in batches:
            for part in chunks(batch):
                _, _, doc, code = word_codes(part)
                held.append(cut(code, doc)[3])
                size += len(part.data)
                if size >= SEND_BYTES:
                    yield out()
                    held, size = [], 0
        yield out()

    counted = some.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(2, HOT_PIECES // share)).select("anchor").toArrow()
    return np.sort(found["anchor"].to_numpy().astype(np.int64).view(np.uint64))


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class _Outbox:
    """Pieces of some documents, by shard; windows of the ``hot`` anchors, by shard."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, hot
        self.clear()

    def clear(self):
        self.parts, self.windows, self.bytes = [], [], 0

    def add(self, part: Texts, ids: np.ndarray, rids: np.ndarray) -> None:
        self.bytes += len(part.data)
        start, end, doc, code = word_codes(part)
        lo, hi, anchor, h = cut(code, doc)
        if not len(lo):
            return
        bounds = part.bounds(doc)
        prefixes = [prefix_sums(mix64(code + np.uint64(k))) for k in (1, 2)]
        if (hot := is_in(h, self.hot)).any():
            n = (hi - lo)[hot]
            at = np.repeat(lo[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self.windows.append((ids[doc[at]], rids[doc[at]], at - bounds[doc[at]],
                                 *[range_hash(x, at, at + WINDOW) for x in prefixes]))
            lo, hi, anchor, h = (x[~hot] for x in (lo, hi, anchor, h))
        if not len(lo):
            return
        stop = hi + WINDOW - 1
        names = [range_hash(x, lo, stop) for x in prefixes]
        a, b = start[lo], end[stop - 1]
        self.parts.append((ids[doc[lo]], rids[doc[lo]], lo - bounds[doc[lo]], hi - lo, anchor - lo, h, *names,
                           b - a, take_ranges(part.data, a, b)))

    def send_windows(self) -> Iterator[pa.RecordBatch]:
        """Windows of hot anchors, without those that a smaller document of the batch has (they are settled)."""
        if not self.windows:
            return
        doc, rid, at, name1, name2 = (np.concatenate(c) for c in zip(*self.windows, strict=True))
        self.windows = []
        later = after_least(doc, name1, name2)
        yield from span_batches(doc[later], rid[later], at[later], at[later] + WINDOW, self.shards, ("shard", "pieces"))
        rows = np.flatnonzero(~later)
        shard = (name1 % np.uint64(self.shards)).astype(np.int64)
        rows = rows[np.argsort(shard[rows], kind="stable")]
        edges = np.flatnonzero(np.append(True, shard[rows][1:] != shard[rows][:-1]))
        out: tuple[list, list] = ([], [])
        for x, y in zip(edges, np.append(edges[1:], len(rows)), strict=True):
            r = rows[x:y]
            out[0].append(int(shard[r[0]]))
            out[1].append(np.stack([doc[r], rid[r], at[r], name1[r].view(np.int64), name2[r].view(np.int64)]).tobytes())
        none = pa.nulls(len(out[0]), pa.int64())
        # A name of text beside the pieces tells that they are windows.
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), none, pa.array(np.zeros(len(none), np.int64)),
             pa.nulls(len(none), pa.binary())], names=["shard", "pieces", "doc_id", "rid", "spans"])

    def send(self) -> Iterator[pa.RecordBatch]:
        yield from self.send_windows()
        if not self.parts:
            return self.clear()
        *columns, text = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.clear()
        doc, rid, at, n, anchor, h, name1, name2, size = columns
        stop = np.cumsum(size)
        # The smallest document of each distinct piece speaks for it; the others are settled.
        order = np.lexsort((doc, name2, name1))
        same = np.zeros(len(order), bool)
        same[1:] = (name1[order[1:]] == name1[order[:-1]]) & (name2[order[1:]] == name2[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        settled = order[same & (doc[order] > doc[lead])]
        yield from span_batches(doc[settled], rid[settled], at[settled], at[settled] + n[settled] + WINDOW - 1,
                                self.shards, ("shard", "pieces"))
        keep = np.ones(len(doc), bool)
        keep[settled] = False
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        rows = np.flatnonzero(keep)
        rows = rows[np.argsort(shard[rows], kind="stable")]
        edges = np.flatnonzero(np.append(True, shard[rows][1:] != shard[rows][:-1])) if len(rows) else rows
        pack = zstandard.ZstdCompressor(level=1)
        out: tuple[list, list] = ([], [])
        for x, y in zip(edges, np.append(edges[1:], len(rows)), strict=True):
            r = rows[x:y]
            who, which = np.unique(np.stack([doc[r], rid[r]], 1), axis=0, return_inverse=True)
            body = b"".join([np.array([len(who), len(r)], np.int64).tobytes(), who.astype(np.int64).tobytes(),
                             which.astype(np.int32).tobytes(), at[r].astype(np.int32).tobytes(),
                             size[r].astype(np.int32).tobytes(), anchor[r].astype(np.uint8).tobytes(),
                             take_ranges(text, stop[r] - size[r], stop[r]).tobytes()])
            out[0].append(int(shard[r[0]]))
            out[1].append(pack.compress(body))
        none = pa.nulls(len(out[0]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), none, none, pa.nulls(len(none), pa.binary())],
            names=["shard", "pieces", "doc_id", "rid", "spans"])


def after_least(doc: np.ndarray, name1: np.ndarray, name2: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same names."""
    order = np.lexsort((doc, name2, name1))
    same = np.zeros(len(order), bool)
    same[1:] = (name1[order[1:]] == name1[order[:-1]]) & (name2[order[1:]] == name2[order[:-1]])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > doc[lead]
    return out


def search_windows(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, text's name, first word, one past the last) of the windows that a smaller document has."""
    doc, rid, at, name1, name2 = np.concatenate([np.frombuffer(b, np.int64).reshape(5, -1) for b in blobs], 1)
    later = after_least(doc, name1, name2)
    return doc[later], rid[later], at[later], at[later] + WINDOW


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Documents, texts' names, first words, sizes, anchors and text of packed pieces."""
    parts = []
    for blob in blobs:
        body = zstandard.ZstdDecompressor().decompress(blob)
        docs, n = np.frombuffer(body, np.int64, 2).tolist()
        at = 16
        out = []
        for kind, count in ((np.int64, 2 * docs), (np.int32, n), (np.int32, n), (np.int32, n), (np.uint8, n)):
            out.append(np.frombuffer(body, kind, count, at))
            at += out[-1].nbytes
        who = out[0].reshape(-1, 2)[out[1]]
        parts.append((who[:, 0], who[:, 1], *out[2:], np.frombuffer(body, np.uint8, offset=at)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def search_shard(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, text's name, first word, one past the last) of removed ranges."""
    doc, rid, at, size, anchor, text = _unpack(blobs)
    piece, code = piece_codes(text, size)
    bounds = np.searchsorted(piece, np.arange(len(size) + 1))
    del text, piece
    n = np.diff(bounds)
    # A match needs its anchor in two documents.
    gram = np.zeros(len(doc), np.uint64)
    for t in range(ANCHOR):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + code[bounds[:-1] + anchor + t]
    _, key = np.unique(gram, return_inverse=True)
    low, high = np.full(key.max() + 1, 2 ** 63 - 1), np.full(key.max() + 1, -2 ** 63)
    np.minimum.at(low, key, doc)
    np.maximum.at(high, key, doc)
    live = np.flatnonzero(low[key] < high[key])
    if not len(live):
        return doc[:0], rid[:0], at[:0], at[:0]
    # Equal pieces are one in the index, with their smallest document.
    names = [range_hash(prefix_sums(mix64(code + np.uint64(k))), bounds[live], bounds[live + 1]) for k in (1, 2)]
    order = np.lexsort((doc[live], *names))
    same = np.zeros(len(live), bool)
    same[1:] = np.all([x[order[1:]] == x[order[:-1]] for x in names], axis=0)
    group = np.empty(len(live), np.int64)
    group[order] = np.cumsum(~same) - 1
    heads = live[order[~same]]
    least = doc[heads]
    # The text of the index: the distinct pieces' words, each piece closed by a zero.
    _, symbol = np.unique(code, return_inverse=True)
    lengths = n[heads]
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    body = np.zeros(int((lengths + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(heads)), lengths)
    where = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chosen = symbol[np.repeat(bounds[heads], lengths) + where]
    _, chosen = np.unique(chosen, return_inverse=True)
    body[begin[owner] + where] = chosen + 1
    index = FMIndex(body)
    windows = np.flatnonzero(where <= np.repeat(lengths - WINDOW, lengths))
    hit, lo, hi = index.repeated(body, begin[owner[windows]] + where[windows], WINDOW)
    # Intervals of one length are equal or apart: the smallest document of each.
    in_order = least[np.searchsorted(begin, index.order, side="right") - 1]
    starts, which = np.unique(lo, return_inverse=True)
    ends = np.empty(len(starts), np.int64)
    ends[which] = hi
    if len(starts):
        cuts = np.stack([starts, ends], 1).ravel()
        padded = np.append(in_order, 2 ** 63 - 1)
        smallest = np.minimum.reduceat(padded, cuts)[::2]
    else:
        smallest = starts
    own = owner[windows[hit]]
    marked = np.zeros(len(owner) + 1, bool)
    marked[windows[hit][smallest[which] < least[own]]] = True
    # To every piece: all its windows if its document isn't the smallest, else the marked ones.
    out = []
    other = np.flatnonzero(doc[live] > least[group])
    out.append((doc[live[other]], rid[live[other]], at[live[other]], at[live[other]] + n[live[other]]))
    mine = np.flatnonzero(doc[live] == least[group])
    first = np.cumsum(lengths) - lengths
    size_ = lengths[group[mine]]
    spot = np.arange(int(size_.sum())) - np.repeat(np.cumsum(size_) - size_, size_)
    src = np.repeat(mine, size_)
    on = np.flatnonzero(marked[np.repeat(first[group[mine]], size_) + spot])
    src, spot = src[on], spot[on]
    out.append((doc[live[src]], rid[live[src]], at[live[src]] + spot, at[live[src]] + spot + WINDOW))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, rid, spans``: for documents with windows that also start in a
    smaller document, lists of word ranges (pairs of 32-bit numbers)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-int(total) // SHARD_BYTES))
    hot = hot_anchors(docs, int(total))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(shards, hot)
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for part in chunks(batch):
                own = slice(part.row, part.row + part.n)
                box.add(part, ids[own], rids[own])
                if box.bytes >= SEND_BYTES:
                    yield from box.send()
        yield from box.send()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in group_tables(batches, ("shard",)):
            there = part["pieces"].is_valid()
            done = part.filter(pc.invert(there))
            if done.num_rows:
                for b in done.combine_chunks().to_batches():
                    yield b.select(["doc_id", "rid", "spans"])
            windows = pc.and_(there, part["rid"].is_valid())
            for find, kind in ((search_shard, pc.and_not(there, windows)), (search_windows, windows)):
                blobs = part["pieces"].filter(kind).to_pylist()
                if blobs:
                    for b in span_batches(*find(blobs), shards, ("shard", "pieces")):
                        yield b.select(["doc_id", "rid", "spans"])

    sent = docs.mapInArrow(cut_up, "shard long, pieces binary, doc_id long, rid long, spans binary")
    sent = sent.repartition("shard").sortWithinPartitions("shard")
    return sent.mapInArrow(search, "doc_id long, rid long, spans binary")


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, and what they are."""
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            words = text.as_py().split() if text.is_valid else []
            n_words.append(len(words))
            if spans.is_valid:
                depth = np.zeros(len(words) + 1, np.int64)
                for blob in spans.as_py():
                    pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
                    np.add.at(depth, pairs[:, 0], 1)
                    np.add.at(depth, pairs[:, 1], -1)
                words = [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]
            n_removed.append(n_words[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word goes if a window over it also starts in a document with a smaller
    id; windows never cross documents and are judged on the input. Null and
    empty texts have no words. A null id counts as the largest. Rows with one
    id don't remove each other's words; equal rows get equal results. An
    empty table gives no rows; other columns are not read.
    """
    named = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    spans = repeated_ranges(named.select(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("doc_id"), "rid", "text"))
    spans = staged(spans.groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("spans")), "spans")
    rows = named.withColumn("_id", F.coalesce("doc_id", F.lit(2 ** 63 - 1)))
    rows = sized_broadcast_join(rows, spans.withColumnRenamed("doc_id", "_id"), ["_id", "rid"], "left", salt=1)
    return rows.select("doc_id", "text", "spans").mapInArrow(
        _rest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_passages(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
