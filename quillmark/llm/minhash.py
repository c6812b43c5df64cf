"""MinHash near-dedup with SuperMinHash signatures.

A document's set is its distinct 5-word shingles. SuperMinHash (Ertl, 2017)
gives every element one random permutation of the signature's slots: in step j
the element offers the value j + r, with r uniform in [0, 1), to the j-th slot
of its permutation. The ranks an element offers are thus correlated across
slots, which lowers the variance of the estimate, and a document stops early:
once every slot has a value below j + 1, no later step can change one. The
steps run for all elements of a chunk of documents at once.

Equal sets are one class first. Classes that share a band meet in a task,
which hands out a union-find forest of the pairs whose signatures agree well
enough (four and a half standard errors under the threshold). The components
of that are groups that hold every link. Each group is then resolved exactly,
on full sets: pairs by falling estimate, none that union-find has already
joined. A group of more than ``BLOCK`` classes is dealt in blocks, with some
members common to all blocks; what isn't in the group's largest component then
is compared with every block. Pairs are never listed, nothing is left out, and
no task holds a large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import BYTE_CODE, CHUNK_BYTES, binaries, chunks, mix64, prefix_sums, range_hash, tidy, window_hash
from quillmark.llm.blocks import block_pairs, group_tables
from quillmark.llm.features import lowered
from quillmark.llm.graph import UnionFind, components
from quillmark.llm.tables import documents, named_rows, staged
from quillmark.operators.joins import sized_broadcast_join

#: Words a shingle, and the least similarity of a link in percent where none is given.
SHINGLE, PERCENT = 5, 85
#: Slots a band, how often a pair at the threshold may share none of the bands, and
#: standard errors under the threshold from which a pair can be a link.
ROWS, MISS, ERRORS = 5, 1e-6, 4.5
#: Text bytes whose shingles a task holds at once.
SIGN_BYTES = 1 << 18
#: Classes a block, and members of a larger group that all its blocks have in common.
BLOCK, COMMON = 512, 16



class Scheme(NamedTuple):
    """What follows from the least similarity of a link, in percent."""

    percent: int
    bands: int
    slots: int
    #: Equal slots from which a pair can be a link.
    agree: int


def scheme(percent: int) -> Scheme:
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be in 1..100, not {percent}")
    p = percent / 100
    bands = 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-p ** ROWS))
    slots = bands * ROWS
    return Scheme(percent, bands, slots, max(0, math.floor(slots * p - ERRORS * math.sqrt(slots * p * (1 - p)))))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(part) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document of a chunk (its
    letters A-Z lowered), one after the other, and their bounds."""
    part = lowered(part)
    start, end, doc = part.words()
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(part.n + 1, np.int64)
    word = range_hash(prefix_sums(BYTE_CODE[part.data]), start, end)
    h, at = window_hash(word, doc, SHINGLE)
    owner = doc[at]
    # Fewer words than a shingle: the whole sequence is the one element.
    bounds = part.bounds(doc)
    counts = np.diff(bounds)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = np.full(len(short), np.uint64(k))
            for t in range(k):
                whole = whole * _ODD + word[bounds[short] + t]
            h, owner = np.concatenate([h, mix64(whole)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(part.n + 1))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (documents by slots): step in the high 32 bits, random part in the low."""
    n = len(bounds) - 1
    out = np.full(n * slots, np.uint64(2 ** 64 - 1))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    live, swaps = elements, []
    for j in range(slots):
        if not len(live):
            break
        r = mix64(live + np.uint64((2 * j + 1) * int(_ODD) % 2 ** 64))
        k = (j + (mix64(r + _ODD) >> np.uint64(33)).astype(np.int64) % (slots - j)).astype(np.int32)
        # The permutation is only kept as its swaps: follow slot k back through them.
        slot = k.copy()
        for i in range(j - 1, -1, -1):
            slot = np.where(slot == swaps[i], np.int32(i), slot)
        np.minimum.at(out, owner * slots + slot, (np.uint64(j) << np.uint64(32)) | (r & _LOW))
        # A later step looks from position j as well: where this swap put it.
        swaps.append(k)
        done = (out.reshape(n, slots) >> np.uint64(32)).max(1) <= j
        stay = ~done[owner]
        if not stay.all():
            live, owner, swaps = live[stay], owner[stay], [s[stay] for s in swaps]
    return out.reshape(n, slots)


def _sign(batches: Iterator[pa.RecordBatch], to: Scheme) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=SIGN_BYTES):
            sets, bounds = shingle_sets(part)
            # Two sums of mixed elements name a set; with its size, 192 bits.
            names = []
            for seed in (1, 2):
                total = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix64(sets + np.uint64(seed * int(_ODD) % 2 ** 64)), out=total[1:])
                names.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
            sig = mix64(super_minhash(sets, bounds, to.slots)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.row, part.n), pa.array(np.diff(bounds).astype(np.int64)), *names,
                 binaries(sig.reshape(-1), np.arange(part.n + 1) * to.slots)],
                names=["doc_id", "n_shingles", "s1", "s2", "signature"])


def _band(batches: Iterator[pa.RecordBatch], to: Scheme) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, to.bands, ROWS)
        for band in range(to.bands):
            h = np.full(len(sig), np.uint64(band + 1))
            for k in range(ROWS):
                h = mix64(h * _ODD + sig[:, band, k])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0)], names=["bucket", "rep"])


def _alike(sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool,
           least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``left`` the rows of ``right`` (later ones, if the sides
    are the ``same``) whose signatures agree in ``least`` slots, and in how many."""
    other = sig[right]
    for n, a in enumerate(left):
        lo = n + 1 if same else 0
        agree = (other[lo:] == sig[a]).sum(1)
        at = np.flatnonzero(agree >= least)
        if len(at):
            yield a, right[lo + at], agree[at]


def _forest_batch(sets: UnionFind) -> pa.RecordBatch:
    pairs = np.array(sets.forest(), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch], to: Scheme) -> Iterator[pa.RecordBatch]:
    """A forest of the pairs of each bucket whose signatures agree enough."""
    for part in group_tables(batches, ("bucket", "i", "j")):
        if part.num_rows < 2:
            continue
        sets, (b, rep) = UnionFind(), (part[c].to_numpy() for c in ("b", "rep"))
        sig = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint32).reshape(-1, to.slots)
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        for a, found, _ in _alike(sig, np.flatnonzero(b == i), np.flatnonzero(b == j), i == j, to.agree):
            for c in rep[found].tolist():
                sets.union(int(rep[a]), c)
        yield _forest_batch(sets)


def _resolve(batches: Iterator[pa.RecordBatch], to: Scheme) -> Iterator[pa.RecordBatch]:
    """A forest of the links between the two sides of each dealt group:
    ``side`` 0 against 1, 2 among themselves and against the rest. ``c`` is
    the component of a member so far."""
    for part in group_tables(batches, ("grp", "i", "j")):
        sets = UnionFind()
        rep, side, known = (part[c].to_numpy() for c in ("rep", "side", "c"))
        for r, c in zip(rep.tolist(), known.tolist(), strict=True):
            sets.union(r, c)
        elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in part["elements"].combine_chunks()]
        sizes = np.array([len(x) for x in elements])
        sig, ends = np.empty((len(rep), to.slots), np.uint64), np.cumsum(sizes)
        lo = 0
        while lo < len(rep):   # some members at a time: their sets may be long
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + CHUNK_BYTES // 8, side="right")))
            sig[lo:hi] = super_minhash(np.concatenate(elements[lo:hi]), np.append(0, np.cumsum(sizes[lo:hi])), to.slots)
            lo = hi
        if (side == 2).all():
            left = right = np.arange(len(rep))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = []
        for a, found, agree in _alike(sig, left, right, left is right, to.agree):
            fits = 100 * np.minimum(sizes[a], sizes[found]) >= to.percent * np.maximum(sizes[a], sizes[found])
            pairs.append(np.stack([agree[fits], np.full(fits.sum(), a), found[fits]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        linked = UnionFind()
        for _, a, c in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            p, q = int(rep[a]), int(rep[c])
            if sets.find(p) == sets.find(q):
                continue
            both = len(np.intersect1d(elements[a], elements[c], assume_unique=True))
            if 100 * both >= to.percent * (sizes[a] + sizes[c] - both):
                sets.union(p, q)
                linked.union(p, q)
        yield _forest_batch(linked)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=SIGN_BYTES):
            own = batch.slice(part.row, part.n)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), binaries(*shingle_sets(part))],
                                             names=["rep", "grp", "elements"])


def links(docs: DataFrame, groups: DataFrame, to: Scheme) -> DataFrame:
    """``node, component`` of the classes in ``groups`` (``rep, grp``), by links on full sets."""
    rows = sized_broadcast_join(docs.select("doc_id", "text"), groups.withColumnRenamed("rep", "doc_id"), ["doc_id"])
    sets = staged(rows.select("doc_id", "grp", "text").mapInArrow(tidy(_sets), "rep long, grp long, elements binary"), "sets")
    sizes = staged(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    sets = sized_broadcast_join(sets, sizes, ["grp"], salt_by=["rep"])
    # First all pairs inside a block. The blocks of one large group have COMMON members in common.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    common = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n")) < COMMON
    first = (sets.withColumn("i", F.explode(F.when((blocks > 1) & common, F.sequence(F.lit(0), blocks - 1))
                                            .otherwise(F.array(own))))
             .select("grp", "i", F.lit(0).alias("j"), "rep", F.lit(2).alias("side"), F.col("rep").alias("c"), "elements")
             .repartition("grp", "i").sortWithinPartitions("grp", "i", "rep"))
    edges = staged(first.mapInArrow(tidy(lambda b: _resolve(b, to)), "a long, b long"), "links")
    stars = components(edges)
    # What a large group has outside its largest component meets all its blocks.
    large = sets.where(F.col("n") > BLOCK).join(stars.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn(
        "c", F.coalesce("component", "rep"))
    parts = large.groupBy("grp", "c").agg(F.count(F.lit(1)).alias("k"))
    main = staged(parts.groupBy("grp").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("n")).where(
        F.col("n") > F.col("main.k")).select("grp", F.col("main.c").alias("main"),
                                             (F.col("n") - F.col("main.k")).alias("rest")), "main")
    large = sized_broadcast_join(large.drop("component"), main, ["grp"], salt_by=["rep"])
    lefts, rights = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("rest", "n"))
    left = large.where(F.col("c") != F.col("main")).withColumn("i", F.pmod(F.xxhash64("rep"), lefts).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), rights - 1))).withColumn("side", F.lit(0))
    right = large.withColumn("j", F.pmod(F.xxhash64("rep"), rights).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), lefts - 1))).withColumn("side", F.lit(1))
    columns = ["grp", "i", "j", "rep", "side", "c", "elements"]
    second = (left.select(*columns).unionByName(right.select(*columns))
              .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep"))
    more = staged(second.mapInArrow(tidy(lambda b: _resolve(b, to)), "a long, b long"), "more-links")
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents link from a similarity of ``percent`` on; the bands and the
    agreement of signatures follow from it.

    Null and empty texts and texts without words have the empty set, link
    with nothing and are kept. Texts with fewer words than a shingle have one
    element, their whole sequence. Equal sets link (their similarity is 1);
    rows with one id are one
    document, and rows without an id join no group but that of an equal set. An empty table gives no rows; other
    columns are not read.
    """
    to = scheme(percent)
    signed = staged(docs.select("doc_id", "text").mapInArrow(
        tidy(lambda b: _sign(b, to)), "doc_id long, n_shingles long, s1 long, s2 long, signature binary"), "signed")
    name = ["n_shingles", "s1", "s2"]
    classes = staged(signed.where("n_shingles > 0").groupBy(*name).agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature")).where(
            F.col("rep").isNotNull()), "classes")
    rows = classes.select("rep", "signature").mapInArrow(tidy(lambda b: _band(b, to)), "bucket long, rep long")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = staged(rows.join(shared, "bucket"), "members")
    # Signatures travel only to the buckets that have company.
    members = members.join(classes.select("rep", "signature"), "rep")
    near = components(block_pairs(members, "bucket", "rep", BLOCK).mapInArrow(
        tidy(lambda b: _candidates(b, to)), "a long, b long"))
    groups = staged(near.select(F.col("node").alias("rep"), F.col("component").alias("grp")).unionByName(
        near.select(F.col("component").alias("rep"), F.col("component").alias("grp")).distinct()), "groups")
    stars = links(docs, groups, to)
    of_class = classes.join(stars.hint("merge"), F.col("rep") == F.col("node"), "left").select(
        *name, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *name).join(of_class, name, "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def first_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of similarity ``percent``: that of its smallest id
    (null last; rows with one id by a hash of their columns).

    Every row is a document of its own here, whatever id it shares or lacks;
    rows without words are each kept.
    """
    named, row, content = named_rows(docs)
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text"), percent).select(
        F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", content, F.col(row).alias("row"))
    kept = named.select("doc_id", content, row).join(found, F.col(row) == F.col("_row")).groupBy("component_id").agg(
        F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return named.join(kept, row, "left_semi").drop(row, content).select(docs.columns)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 85)
