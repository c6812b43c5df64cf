"""

Re-aimed: the reference scores with a neural LM; this is an add-0.1
bigram model counted from a training table. Same purpose and output
shape, not the same values.

Plan: tasks cut their texts into blocks of about ``BLOCK_BYTES`` and count a
block's grams in numpy (:func:`gram_blocks`). A gram is a string, ``"v w"`` for a
bigram, ``"v "`` for a prefix and ``" w"`` for a word of the vocabulary (no token is
empty or has a space). A block has one row a bucket, the gram's hash deciding the
bucket; a bucket adds up the training blocks and answers each scored block with its
grams' counts (:func:`bucket_totals`). A frequent gram is one string a block,
so none is hot, and neither texts nor token rows travel: of a scored text only its
grams' numbers do, which meet the block's answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import word_codes
from quillmark.operators.joins import estimated_size
from quillmark.session import cut_lineage

BOS = "<s>"
ADD_K = 0.1
# Text of a block, and text whose grams make up a bucket.
BLOCK_BYTES = 16 * 1024 * 1024

ANSWERS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("counts", T.BinaryType()), T.StructField("words", T.LongType())])


def bigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, v, w)`` for every token ``w`` with its predecessor ``v`` (``<s>`` first)."""
    t = df.select(key, tx.tok(text).alias("_t"))
    prev = F.concat(F.array(F.lit(BOS)), F.col("_t"))
    z = F.arrays_zip(F.slice(prev, 1, F.size("_t")).alias("v"), F.col("_t").alias("w"))
    return t.select(key, F.inline(z))


def _blocks_schema(key: T.StructField) -> T.StructType:
    """A block's row a bucket (``grams`` end to end and their ``ends``, ``counts`` if it
    trains) and, if it is scored, one row of bucket -1: ``keys`` of its texts, where their
    grams end (``ends``), the ``grams`` and each gram's prefix (``counts``) by number."""
    return T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("grams", T.BinaryType()), T.StructField("ends", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("keys", T.ArrayType(key.dataType))])


def text_blocks(batches: Iterator[pa.RecordBatch], most: int, texts: int = 1) -> Iterator[pa.Table]:
    """The rows in order, cut where their texts (last columns, no nulls) reach ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[-texts:]))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + most - size, "left")) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += ends[to - 1] - before
            at = to
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _strings(data: bytes, ends: bytes) -> pa.Array:
    offs = np.append(0, np.frombuffer(ends, np.int32)).astype(np.int32)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(data))


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def previous(code: np.ndarray, offs: np.ndarray, bos: int) -> np.ndarray:
    """The token before each token of its text, ``bos`` before the first."""
    prev = np.append(bos, code)[:len(code)]
    prev[offs[:-1][np.diff(offs) > 0]] = bos
    return prev


def dealt_grams(names: pa.Array, left: np.ndarray, right: np.ndarray, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(order, grams, cut)``: the grams of two numbered ``names`` each, in order of bucket,
    and where each bucket begins."""
    h = pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False)
    bucket = ((h[left] * np.uint64(0x9E3779B97F4A7C15) + h[right]) >> np.uint64(20)) % np.uint64(buckets)
    # A stable sort of small integers counts them instead of comparing.
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    grams = pc.binary_join_element_wise(names.take(pa.array(left[order])), names.take(pa.array(right[order])), " ")
    return order, grams, np.searchsorted(bucket[order], np.arange(buckets + 1))


def numbers_used(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, of numbers below ``size``, and each number's place among them."""
    used = np.zeros(size, bool)
    used[x] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[x]


def block_grams(texts: pa.Array, train: bool, buckets: int, least: int | None = None) -> tuple:
    """``(gram, ends, prefix, grams, counts, cut)`` of lower-cased texts: the number of each
    token's bigram, where each text's end, of each gram its prefix's number, the grams in
    order of bucket, their counts and where each bucket begins. ``least``: bigrams alone,
    of words of at least so many characters."""
    code, offs, words = word_codes(texts)
    bos, empty = len(words), len(words) + 1
    token = previous(code, offs, bos) << 32 | code
    if least is not None:
        token = token[pc.binary_length(words).to_numpy(zero_copy_only=False)[code] >= least]
    gram, pairs = pd.factorize(token)
    n = np.bincount(gram, minlength=len(pairs))
    v, w = pairs >> 32, pairs & 0xFFFFFFFF
    firsts, first = numbers_used(v if least is None else v[:0], bos + 1)
    vocabulary = numbers_used(w, bos)[0] if train and least is None else w[:0]
    left = np.concatenate([v, firsts, np.full(len(vocabulary), empty)])
    right = np.concatenate([w, np.full(len(firsts), empty), vocabulary])
    prefixes = np.bincount(first, weights=n[:len(first)], minlength=len(firsts))
    counts = np.concatenate([n, prefixes, np.ones(len(vocabulary))]).astype(np.int64)
    order, grams, cut = dealt_grams(pa.concat_arrays([words, pa.array([BOS, ""])]), left, right, buckets)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    prefix = np.append(place[len(pairs) + first], np.zeros(len(order) - len(first), np.int64))[order]
    return place[gram], offs[1:], prefix, grams, counts[order], cut


def packed(block: int | None, grams: pa.Array, cut: np.ndarray, counts: np.ndarray | None = None) -> list[tuple]:
    """``(block, bucket, grams, ends, counts)`` of every bucket that has grams."""
    offs = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset:grams.offset + len(grams) + 1]
    data = memoryview(grams.buffers()[2] or b"")
    return [(block, b, bytes(data[offs[lo]:offs[hi]]), (offs[lo + 1:hi + 1] - offs[lo]).tobytes(),
             None if counts is None else counts[lo:hi].tobytes())
            for b, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if lo < hi]


def gram_blocks(df: DataFrame, key: str, text: str, train: bool, score: bool, buckets: int,
                least: int | None = None) -> DataFrame:
    """Blocks of ``df`` as rows of :func:`_blocks_schema`. A block is known by its task and
    its place there: read the result from one copy."""
    schema = _blocks_schema(df.schema[key])
    kept = F.col(key).isNotNull() & F.col(text).isNotNull() if score and not train else F.col(text).isNotNull()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for no, t in enumerate(text_blocks(batches, BLOCK_BYTES)):
            gram, ends, prefix, grams, counts, cut = block_grams(column(t, "_text"), train, buckets, least)
            block = task << 32 | no if score else None
            out = packed(block, grams, cut, counts if train else None)
            if score:
                out.append((block, -1, gram.astype(np.int32).tobytes(), ends.astype(np.int64).tobytes(),
                            prefix.astype(np.int32).tobytes()))
            if out:
                columns = [pa.array(c, f) for c, f in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                keys = column(t, "_key")
                own = np.zeros(len(out) + 1, np.int32)
                own[-1] = len(keys) if score else 0
                columns.append(pa.ListArray.from_arrays(pa.array(own), keys if score else keys[:0]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.where(kept).select(F.col(key).alias("_key"), F.lower(text).alias("_text")).mapInArrow(rows, schema)


def _totals(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: its distinct grams and their training counts, the number of each gram
    of the rows, and where the rows begin."""
    counts = t.column("counts").to_pylist()
    pieces = [_strings(*x) for x in zip(t.column("grams").to_pylist(), t.column("ends").to_pylist(), strict=True)]
    cut = np.cumsum([0] + [len(p) for p in pieces])
    coded = pa.concat_arrays(pieces).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(coded.dictionary), np.int64)
    for a, b, c in zip(cut, cut[1:], counts, strict=False):
        if c is not None:
            total[code[a:b]] += np.frombuffer(c, np.int64)   # a block's grams are distinct
    return coded.dictionary, total, code, cut


def bucket_bigrams(t: pa.Table) -> pa.Table:
    """``(v, w, c)``: the bigrams of a bucket and their training counts (no other grams among them)."""
    grams, total, _, _ = _totals(t)
    words = pc.split_pattern(grams, " ").flatten()
    return pa.table([words.take(pa.array(np.arange(i, len(words), 2))) for i in (0, 1)] + [pa.array(total)], names=["v", "w", "c"])


def bucket_totals(t: pa.Table) -> pa.Table:
    """Of one bucket: the training counts of each scored block's grams, in their order, and
    in one row without a block the words of the vocabulary."""
    blocks, buckets = (t.column(c).to_pylist() for c in ("block", "bucket"))
    grams, total, code, cut = _totals(t)
    word = pc.starts_with(grams, " ").to_numpy(zero_copy_only=False)
    out = [(block, bucket, total[code[a:b]].tobytes(), None)
           for a, b, block, bucket in zip(cut, cut[1:], blocks, buckets, strict=False) if block is not None]
    out.append((None, buckets[0], None, int((total[word] > 0).sum())))
    return pa.table([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (
        pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=ANSWERS.names)


def answered(answers: pa.Table) -> np.ndarray:
    """The counts of a block's grams, in their order."""
    found = answers.column("counts").to_pylist()
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(found[i], np.int64) for i in order]])


def _block_scores(key: T.StructField, vocab: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``(key, n, s)`` of a block's texts: tokens and the sum of their log-probabilities."""
    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        c = answered(answers).astype(np.float64)
        gram, prefix = (np.frombuffer(texts.column(x)[0].as_py(), np.int32) for x in ("grams", "counts"))
        ends = np.frombuffer(texts.column("ends")[0].as_py(), np.int64)
        n = np.diff(ends, prepend=0)
        ln = np.log(c + ADD_K) - np.log(c[prefix] + ADD_K * vocab)
        s = np.bincount(np.repeat(np.arange(len(n)), n), weights=ln[gram], minlength=len(n))
        return pa.table([column(texts, "keys").flatten(), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=[key.name, "n", "s"])
    return scored


def lm_perplexity(train: DataFrame, score: DataFrame, key: str = "doc_id",
                  text: str = "text", train_text: str = "text") -> DataFrame:
    """Per-row ``(key, n_tokens, perplexity)``; NULL perplexity without tokens.

    ``ln p(w|v) = ln(c(v,w) + k) - ln(c(v) + kV)``, V = distinct training tokens + 1;
    a gram that the training texts lack has a count of 0. Rows of one key are one text's.
    """
    same = train is score and text == train_text
    size = sum(estimated_size(df.select(c))[1] for df, c in [(score, text)] + ([] if same else [(train, train_text)]))
    buckets = math.ceil(size / BLOCK_BYTES) or 1
    own = score.schema[key]
    if same:
        blocks = cut_lineage(gram_blocks(score, key, text, True, True, buckets))
    else:
        learnt = gram_blocks(train.select(F.lit(None).cast(own.dataType).alias(key), F.col(train_text).alias("_train")),
                             key, "_train", True, False, buckets)
        blocks = cut_lineage(gram_blocks(score, key, text, False, True, buckets).unionByName(learnt))
    answers = cut_lineage(blocks.where("bucket >= 0").select("block", "bucket", "grams", "ends", "counts")
                          .groupBy("bucket").applyInArrow(bucket_totals, ANSWERS))
    vocab = float(answers.agg(F.sum("words")).first()[0] or 0) + 1.0
    schema = T.StructType([T.StructField(key, own.dataType), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])
    texts = blocks.where("bucket = -1").groupBy("block").cogroup(
        answers.where(F.col("block").isNotNull()).select("block", "bucket", "counts").groupBy("block")).applyInArrow(
            _block_scores(own, vocab), schema)
    per = texts.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = score.select(key).join(per, key, "left")
    return out.select(key, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_tokens"),
                      F.round(F.exp(-F.col("s") / F.col("n")), 4).alias("perplexity"))


def mean_perplexity(scores: DataFrame, by: str | None = None) -> DataFrame:
    """``mean_perplexity`` (texts without tokens left out) and ``texts`` that have one, per ``by`` or in all."""
    g = scores.groupBy(by) if by else scores.groupBy()
    return g.agg(tx.r6(F.avg("perplexity")).alias("mean_perplexity"), F.count("perplexity").alias("texts"))
