"""Suffix-array dedup over bytes: a distributed merge sort of suffixes that knows common prefixes.

A string is ``LENGTH`` bytes from any position. Its anchor is the position in
it where the hash of ``GRAM`` bytes is smallest (the first such): equal strings
have their anchors at the same offset. Only suffixes at anchors are sorted,
about one for seventy bytes; strings that share an anchor lie side by side.

Each task sorts the suffixes of some megabytes of text by the hash of their
first ``GRAM`` bytes, in ranges, and by their bytes; it front-codes the sorted
run (common prefix with the suffix before, then the rest) and sends it in those
ranges; a suffix carries the bytes before it that strings over it can reach.
Suffixes that share less than ``GRAM`` bytes have no string in common, so ranges
of the hash part no class, and are even whatever the texts are.
A range's runs are merged by a loser tree that never compares a known common
prefix again, which also yields every suffix's common prefix with its
neighbour. For an offset ``o``, two strings are equal if their suffixes share
``LENGTH - o`` bytes and the ``o`` bytes before them are the same: the suffix
order gives the classes of the first, and the second is compared in each class.

Stretches of text around an anchor that a task has seen twice are settled
there, and one of them is sent, so copies of one passage send a few.

A passage in very many documents, with different text on either side, gives as
many different suffixes with the same first bytes. Such grams are counted first,
and the strings of their stretches are dealt by a hash of the whole string
instead, so that no task holds all of them.
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

from quillmark.llm.batches import BYTE_CODE, Texts, chunks, mix64, prefix_sums, range_hash, tidy
from quillmark.llm.blocks import group_tables, span_batches
from quillmark.llm.lcpmerge import decode_run, merge_runs
from quillmark.llm.passages import is_in, take_ranges
from quillmark.llm.tables import documents, staged
from quillmark.operators.joins import sized_broadcast_join

#: Bytes of a string, of the gram that is hashed, and starts of grams in a string.
LENGTH, GRAM = 200, 64
STARTS = LENGTH - GRAM + 1
#: Text bytes a range, on average, before overlap, and text bytes sorted at once by a task.
RANGE_BYTES, SORT_BYTES = 4 << 20, 8 << 20
#: A gram is hot from about so many different stretches on, and grams that can be hot, at most (the most frequent).
HOT_STRETCHES, HOT_GRAMS = 1 << 14, 1 << 20
#: Text bytes, at least, in which hot grams are counted (of more text a share, by a hash).
COUNT_BYTES = 64 << 20
#: Ranges of hot strings for each range of suffixes, and stretches whose strings are named at once.
HOT_PARTS, HOT_BLOCK = 8, 1 << 11
#: An anchor's place in a chunk takes so many bits; the rest are its hash.
PLACE_BITS = 28

_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor, first and last string start of every stretch of a
    chunk, and the prefix sums of its bytes. A stretch is all consecutive
    strings with one anchor."""
    sums = prefix_sums(BYTE_CODE[part.data])
    size = np.maximum(np.diff(part.offsets) - LENGTH + 1, 0)
    n = int(size.sum())
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, sums
    at = np.arange(len(part.data) - GRAM + 1)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (range_hash(sums, at, at + GRAM) & ~place) | at.astype(np.uint64)
    span = 1
    while 2 * span <= STARTS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < STARTS:
        least = np.minimum(least[:-(STARTS - span)], least[STARTS - span:])
    doc = np.repeat(np.arange(part.n), size)
    start = np.arange(n) + np.repeat(part.offsets[:-1] - (np.cumsum(size) - size), size)
    anchor = (least[start] & place).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    return doc[first], anchor[first], start[first], start[last], sums


def names_of(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of ranges of bytes: the whole, and its two halves."""
    middle = (first + end) // 2
    return range_hash(sums, first, end), mix64(range_hash(sums, first, middle) * _ODD + range_hash(sums, middle, end))


def repeats(name1: np.ndarray, name2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What has a twin by both names, and one of each kind."""
    order = np.lexsort((name2, name1))
    same = np.zeros(len(order), bool)
    same[1:] = (name1[order[1:]] == name1[order[:-1]]) & (name2[order[1:]] == name2[order[:-1]])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(order), bool)
    out[order] = twice
    return out, order[~same]


class _Sorter:
    """Stretches of some documents: settles repeats, sorts the rest into a front-coded run."""

    def __init__(self, ranges: int, hot: np.ndarray):
        self.ranges, self.hot = ranges, hot
        self.clear()

    def clear(self):
        self.data, self.parts, self.bytes = [], [], 0

    def add(self, part: Texts, ids: np.ndarray, rids: np.ndarray) -> None:
        doc, anchor, first, last, sums = anchors(part)
        name1, name2 = names_of(sums, first, last + LENGTH)
        name1 = mix64(name1 + (anchor - first).astype(np.uint64))   # with the anchor's place
        gram = range_hash(sums, anchor, anchor + GRAM)
        begin = part.offsets[doc]
        self.parts.append((ids[doc], rids[doc], anchor - begin, anchor - last, anchor - first, anchor + self.bytes,
                           name1, name2, gram))
        self.data.append(part.data)
        self.bytes += len(part.data)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        doc, rid, at, lo, hi, place, name1, name2, gram = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        data = np.concatenate(self.data)
        self.clear()
        if not len(doc):
            return
        done, r = repeats(name1, name2)
        x = np.flatnonzero(done)
        yield from span_batches(doc[x], rid[x], at[x] - hi[x], at[x] - lo[x] + LENGTH, self.ranges, ("part", "run"))
        hot = is_in(gram[r], self.hot)
        if hot.any():
            k = r[hot]
            yield from self.send_strings(data, *(c[k] for c in (doc, rid, at, lo, hi, place, done)))
            r = r[~hot]
        if not len(r):
            return
        # One of each distinct stretch goes out, by its suffix.
        where = (mix64(gram[r]) % np.uint64(self.ranges)).astype(np.int64)
        size = (LENGTH - lo[r]).astype(np.int64)
        padded = np.append(data, np.zeros(LENGTH, np.uint8))
        text = padded[place[r][:, None] + np.arange(LENGTH)]
        text[np.arange(LENGTH) >= size[:, None]] = 0
        by = np.lexsort((size, text.view(f"S{LENGTH}").ravel(), where))
        r, size, text, where = r[by], size[by], text[by], where[by]
        lcp = np.zeros(len(r), np.int64)
        for a in range(1, len(r), 1 << 16):
            b = min(len(r), a + (1 << 16))
            differ = text[a:b] != text[a - 1:b - 1]
            lcp[a:b] = np.where(differ.any(1), differ.argmax(1), LENGTH)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
        edges = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        pack, out = zstandard.ZstdCompressor(level=1), ([], [])
        for p, q in zip(edges, np.append(edges[1:], len(r)), strict=True):
            k = r[p:q]
            known = lcp[p:q].copy()
            known[0] = 0
            who, which = np.unique(np.stack([doc[k], rid[k]], 1), axis=0, return_inverse=True)
            begin = place[k]
            out[0].append(int(where[p]))
            out[1].append(pack.compress(b"".join([
                np.array([len(who), len(k)], np.int64).tobytes(), who.astype(np.int64).tobytes(),
                which.astype(np.int32).tobytes(), at[k].astype(np.int32).tobytes(), lo[k].astype(np.uint8).tobytes(),
                hi[k].astype(np.uint8).tobytes(), done[k].astype(np.uint8).tobytes(), known.astype(np.uint8).tobytes(),
                take_ranges(data, begin - hi[k], begin).tobytes(),
                take_ranges(data, begin + known, begin + size[p:q]).tobytes()])))
        yield _runs(*out)

    def send_strings(self, data, doc, rid, at, lo, hi, place, done) -> Iterator[pa.RecordBatch]:
        """The strings of stretches, by their names: those a task sees twice are settled, one of each goes out."""
        for a in range(0, len(doc), HOT_BLOCK):
            own = slice(a, a + HOT_BLOCK)
            first, end, n = (place - hi)[own], (place - lo)[own] + LENGTH, (hi - lo)[own] + 1
            sums = prefix_sums(BYTE_CODE[take_ranges(data, first, end)])
            which = np.repeat(np.arange(len(n)), n) + a
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(np.cumsum(end - first) - (end - first), n) + step
            name1, name2 = names_of(sums, begin, begin + LENGTH)
            start = (at - hi)[which] + step
            twice, r = repeats(name1, name2)
            x = np.flatnonzero(twice & ~done[which])
            yield from span_batches(doc[which[x]], rid[which[x]], start[x], start[x] + LENGTH, self.ranges, ("part", "run"))
            settled = (twice | done[which])[r]
            where = (mix64(name1[r]) % np.uint64(HOT_PARTS * self.ranges)).astype(np.int64) + self.ranges
            by = np.argsort(where, kind="stable")
            r, settled, where = r[by], settled[by], where[by]
            edges = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            pack, out = zstandard.ZstdCompressor(level=1), ([], [])
            for p, q in zip(edges, np.append(edges[1:], len(r)), strict=True):
                k = r[p:q]
                out[0].append(int(where[p]))
                out[1].append(pack.compress(b"".join([
                    name1[k].tobytes(), name2[k].tobytes(), doc[which[k]].astype(np.int64).tobytes(),
                    rid[which[k]].astype(np.int64).tobytes(), start[k].astype(np.int32).tobytes(),
                    settled[p:q].astype(np.uint8).tobytes()])))
            yield _runs(*out)


def _runs(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(parts), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int64()), pa.array(blobs, pa.binary()), none, none, pa.nulls(len(none), pa.binary())],
        names=["part", "run", "doc_id", "rid", "spans"])


def match_strings(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, text's name, first byte, one past the last) of hot strings that have a twin."""
    columns = []
    for blob in blobs:
        body = zstandard.ZstdDecompressor().decompress(blob)
        n, at, out = len(body) // 37, 0, []
        for kind in (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8):
            out.append(np.frombuffer(body, kind, n, at))
            at += out[-1].nbytes
        columns.append(out)
    name1, name2, doc, rid, start, settled = (np.concatenate(c) for c in zip(*columns, strict=True))
    twice, _ = repeats(name1, name2)
    x = np.flatnonzero(twice & (settled == 0))
    start = start[x].astype(np.int64)
    return doc[x], rid[x], start, start + LENGTH


def _unpack(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    docs, n = np.frombuffer(body, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in ((np.int64, 2 * docs), (np.int32, n), (np.int32, n), *[(np.uint8, n)] * 4):
        out.append(np.frombuffer(body, kind, count, at))
        at += out[-1].nbytes
    who, which, place, lo, hi, done, lcp = out
    who = who.reshape(-1, 2)[which]
    left = np.frombuffer(body, np.uint8, int(hi.sum(dtype=np.int64)), at)
    known = lcp.tolist()
    strings = decode_run(known, np.cumsum(LENGTH - lo.astype(np.int64) - lcp).tolist(), body[at + len(left):])
    return (strings, known), (who[:, 0], who[:, 1], place.astype(np.int64), lo.astype(np.int64),
                              hi.astype(np.int64), done.astype(bool), left)


def search_range(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, text's name, first byte, one past the last) of removed ranges."""
    runs, columns = zip(*[_unpack(b) for b in blobs], strict=True)
    order, prefix = merge_runs(list(runs))
    base = np.cumsum([0] + [len(r[0]) for r in runs])
    run, pos = np.array(order, np.int64).T
    item = base[run] + pos
    doc, rid, place, lo, hi, done, left = (np.concatenate(c) for c in zip(*columns, strict=True))
    ends = np.cumsum(hi)[item]
    doc, rid, place, lo, hi, done = (c[item] for c in (doc, rid, place, lo, hi, done))
    lcp = np.append(prefix, 0)
    lcp[0] = 0
    near = np.maximum(lcp[:-1], lcp[1:]) >= GRAM
    live = np.flatnonzero(near & ~done)
    if not len(live):
        return doc[:0], rid[:0], place[:0], place[:0]
    out = []
    seen = np.full(len(doc), -1, np.int64)   # first offset of the open run of offsets
    before = np.zeros(len(doc), np.uint64)
    top = int(hi[near].max())
    # Settled stretches take part in every comparison; only the others report.
    for o in range(top + 1):
        if o:
            able = np.flatnonzero(near & (hi >= o))
            before[able] = before[able] * _ODD + BYTE_CODE[left[ends[able] - o]]
        on = np.flatnonzero(near & (lo <= o) & (o <= hi))
        hit = on[:0]
        if len(on):
            classes = np.cumsum(lcp[:-1] < LENGTH - o)
            key = mix64(classes[on].astype(np.uint64) * _ODD + mix64(before[on].copy()))
            by = np.argsort(key)
            same = key[by[1:]] == key[by[:-1]]
            twice = np.zeros(len(on), bool)
            twice[by[1:][same]] = True
            twice[by[:-1][same]] = True
            hit = on[twice & ~done[on]]
        flag = np.zeros(len(doc), bool)
        flag[hit] = True
        seen[flag & (seen < 0)] = o
        over = np.flatnonzero(~flag & (seen >= 0))
        if len(over):
            out.append((over, seen[over], np.full(len(over), o - 1)))
            seen[over] = -1
    over = np.flatnonzero(seen >= 0)
    out.append((over, seen[over], np.full(len(over), top)))
    x, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    return doc[x], rid[x], place[x] - b, place[x] - a + LENGTH


def hot_grams(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes, in order, of the grams at anchors with about ``HOT_STRETCHES``
    different stretches or more (copies of one stretch count once: tasks settle
    them). At most HOT_GRAMS, the most frequent."""
    share = max(1, min(total // COUNT_BYTES, HOT_STRETCHES // 32))   # a hot one is met 32 times and more
    some = docs.where(F.pmod(F.xxhash64("doc_id", "rid"), F.lit(share)) == 0) if share > 1 else docs

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, anchor, first, last, sums = anchors(part)
                both = np.stack([range_hash(sums, anchor, anchor + GRAM), names_of(sums, first, last + LENGTH)[0]], 1)
                both = np.unique(both, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["gram", "name"])

    found = some.select("text").mapInArrow(tidy(grams), "gram long, name long").groupBy("gram", "name").agg(
        F.lit(1).alias("one")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") >= max(2, HOT_STRETCHES // share)).orderBy(F.desc("n"), "gram").limit(HOT_GRAMS)
    return np.sort(found.select("gram").toArrow()["gram"].to_numpy().astype(np.int64).view(np.uint64))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, rid, spans``: lists of byte ranges (pairs of 32-bit numbers)
    covered by strings that start in two places."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-int(total) // RANGE_BYTES))
    hot = hot_grams(docs, int(total))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(ranges, hot)
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for part in chunks(batch):
                own = slice(part.row, part.row + part.n)
                sorter.add(part, ids[own], rids[own])
                if sorter.bytes >= SORT_BYTES:
                    yield from sorter.send()
        yield from sorter.send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in group_tables(batches, ("part",)):
            there = part["run"].is_valid()
            settled = part.filter(pc.invert(there))
            for b in settled.combine_chunks().to_batches():
                yield b.select(["doc_id", "rid", "spans"])
            blobs = part["run"].filter(there).to_pylist()
            if blobs:
                found = (search_range if part["part"][0].as_py() < ranges else match_strings)(blobs)
                for b in span_batches(*found, ranges, ("part", "run")):
                    yield b.select(["doc_id", "rid", "spans"])

    sent = docs.mapInArrow(tidy(sort), "part long, run binary, doc_id long, rid long, spans binary")
    sent = sent.repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(tidy(merge), "doc_id long, rid long, spans binary")


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that stay, and what they are."""
    for batch in batches:
        sizes, removed, runs, digests = [], [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            text = text.as_py() or b""
            digest, at, gone, n = hashlib.sha256(), 0, 0, 0
            if spans.is_valid:
                pairs = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in spans.as_py()])
                end = -1
                for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                    if a > end:
                        n += 1
                        digest.update(text[at:a])
                        gone += b - a
                    else:
                        gone += max(0, b - end)
                    at = end = max(end, b)
            digest.update(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            runs.append(n)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A byte goes if a string over it also starts anywhere else, in the same
    row or another; strings never cross rows and are judged on the input.
    Null and empty texts have no bytes. Rows equal in id and text are two
    places (both lose what they share). An empty table gives no rows; other
    columns are not read.
    """
    named = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    known = F.coalesce("doc_id", F.lit(-2 ** 63))
    spans = repeated_ranges(named.select(known.alias("doc_id"), "rid", "text"))
    spans = staged(spans.groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("spans")), "spans")
    rows = named.withColumn("_id", known)
    rows = sized_broadcast_join(rows, spans.withColumnRenamed("doc_id", "_id"), ["_id", "rid"], "left", salt=1)
    return rows.select("doc_id", "text", "spans").mapInArrow(
        tidy(_rest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
