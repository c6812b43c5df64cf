"""

Re-aimed: the reference measures how much a summary helps a masked
language model fill blanks in the document. Here the "model" is corpus
bigram counts: every 6th word (length >= 4) of the document is masked and
guessed from its left neighbour, without help (``base``), with the
summary's words as the only candidates (``help``), and with the summary's
own bigrams boosting the counts (``tune``). Score = (correct with help -
correct without) / masked. Integer counts only, so the result is exact.

Document = gold, summary = predicted (the reference's argument order).

No candidate list per position is built. The corpus is counted in blocks of text
(:mod:`quillmark.operators.metrics.lm`). Of each left word v it gives one row: its
``TOP`` most frequent continuations in order and a bitmap of all of them (a Bloom
filter of ``BITS`` bits, one hash); both are cut down inside the tasks before v is
exchanged. Pairs are read in blocks too, which keep tokens, masks and word lists as
packed numbers: a block asks once for each of its masked left words and meets their
rows in a cogroup. The first of the top words that the summary has is the exact
``help`` guess. Only where it has none, and v has more continuations, are the
summary's words tested against the bitmap. What passes, and the summary's own bigrams
for ``tune``, are asked once a block and answered by the buckets that add up the
corpus, as in perplexity. No candidates are joined by v alone, whatever a word's
fan-out in the corpus; rows that share a key with another are joined relationally.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import word_codes
from quillmark.operators.joins import estimated_size, probe_sample, split_lookup, split_repeated
from quillmark.operators.metrics import lm
from quillmark.operators.metrics.lm import bigrams
from quillmark.session import cut_lineage

MASK_EVERY = 6
MIN_WORD_LEN = 4
TUNE_BOOST = 10
# Continuations of a left word that are kept in order, and bits of the bitmap of all.
TOP = 64
BITS = 1024
_WORDS = BITS // 64
# Words of pairs tested against bitmaps at once.
TEST_ITEMS = 1 << 21

_GUESSES = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("grams", T.BinaryType()),
    T.StructField("ends", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_HITS = ["masked", "base_correct", "help_correct", "tune_correct"]


def _place(w: Column) -> Column:
    """A word's place in a bitmap."""
    return F.pmod(F.crc32(w), F.lit(BITS)).cast("int")


def left_words(cc: DataFrame, top: int = TOP) -> DataFrame:
    """``(v, top, s_base, bits)`` of corpus counts ``(v, w, c)``: the ``top`` most
    frequent continuations (ties: the smaller word first), the count of the
    first, and the bitmap of all as ``array<bigint>`` (null where ``top`` has them all)."""
    first = Window.partitionBy("v").orderBy(F.col("c").desc(), "w")
    # Planned as a limit a word and task before the exchange, then at most ``top`` rows a word.
    heads = cc.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).groupBy("v").agg(
        F.sort_array(F.collect_list(F.struct("_r", "w"))).alias("_t"), F.max("c").alias("s_base"))
    at = cc.withColumn("_at", _place(F.col("w")))
    word, bit = F.floor(F.col("_at") / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at") % 64)
    maps = at.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), *[
        F.bit_or(F.when(word == i, bit)).alias(f"_m{i}") for i in range(_WORDS)]).where(F.col("_n") > top)
    maps = maps.select("v", F.array(*[F.coalesce(f"_m{i}", F.lit(0).cast("long")) for i in range(_WORDS)]).alias("bits"))
    return heads.join(maps, "v", "left").select(
        "v", F.transform("_t", lambda x: x["w"]).alias("top"), "s_base", "bits")


def _masks(tp: DataFrame, key: str) -> DataFrame:
    pos = tp.select(key, "g", F.posexplode("g").alias("p0", "answer"))
    i = F.col("p0") + 1
    return pos.where((i >= 2) & (i % MASK_EVERY == 0) & (F.length("answer") >= MIN_WORD_LEN)) \
        .select(key, F.element_at("g", F.col("p0")).alias("v"), "answer")


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of two columns in order, how often each occurs, and the number of each row's."""
    key, inverse, n = np.unique(columns[0] << 32 | columns[1], return_inverse=True, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n, inverse


def pair_block(g: pa.Array, h: pa.Array) -> dict:
    """Of a block's lower-cased texts by number: the distinct tokens ``words``; the masked
    left words ``v`` of each ``row``; the masks' ``answer`` words, each with its left word's
    place ``of`` and occurrences ``k``; the long words ``w`` of each predicted text
    (``word_row``); and its bigrams ``own`` of a masked left word ``own_of``, ``cp`` times."""
    n = len(g)
    code, offs, words = word_codes(pa.concat_arrays([g, h]))
    long_w = pc.binary_length(words).to_numpy(zero_copy_only=False) >= MIN_WORD_LEN
    row = np.repeat(np.arange(2 * n), np.diff(offs))
    at = np.arange(len(code))
    predicted = row >= n
    masked = at[~predicted & ((at - offs[row]) % MASK_EVERY == MASK_EVERY - 1) & long_w[code]]
    pv_row, v, _, pv = _grouped(row[masked], code[masked - 1])
    of, answer, k, _ = _grouped(pv, code[masked])
    kept = predicted & long_w[code]
    word_row, w, _, _ = _grouped(row[kept] - n, code[kept])
    left = (row - n) << 32 | lm.previous(code, offs, len(words))
    known = pv_row << 32 | v
    place = np.searchsorted(known, left[kept])
    found = place < len(known)
    found[found] = known[place[found]] == left[kept][found]
    own_of, own, cp, _ = _grouped(place[found], code[kept][found])
    return {"words": words, "rows": n, "row": pv_row, "v": v, "of": of, "answer": answer, "k": k,
            "word_row": word_row, "w": w, "own_of": own_of, "own": own, "cp": cp}


def _pair_blocks(pairs: DataFrame, key: str) -> DataFrame:
    """``(block, keys, state, lefts)``: blocks of pairs, their distinct masked left words as
    ``lefts``. A block is known by its task and its place there: read the result from one copy."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(pairs.schema[key].dataType)),
        T.StructField("state", T.BinaryType()), T.StructField("lefts", T.ArrayType(T.StringType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for no, t in enumerate(lm.text_blocks(batches, lm.BLOCK_BYTES, 2)):
            state = pair_block(lm.column(t, "_g"), lm.column(t, "_h"))
            keys, lefts = lm.column(t, "_key"), state["words"].take(pa.array(np.unique(state["v"])))
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | no], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.array([pickle.dumps(state)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(lefts)], pa.int32()), lefts)], names=schema.names)

    plain = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in (("gold", "_g"), ("predicted", "_h"))]
    return pairs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *plain).mapInArrow(rows, schema)


def _among(row: np.ndarray, word: np.ndarray, state: dict) -> np.ndarray:
    """Whether the predicted text of ``row`` has the long word ``word`` (-1: no word of the block)."""
    if not len(state["w"]):
        return np.zeros(len(row), bool)
    have = state["word_row"] << 32 | state["w"]
    want = row << 32 | word
    return (word >= 0) & (have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want)


def _may_follow(pv: np.ndarray, bits: np.ndarray, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """``(pv, w)``: the long words of each pair of the left words ``pv`` that pass its bitmap."""
    place = np.array([zlib.crc32(x) % BITS for x in state["words"].cast(pa.binary()).to_pylist()], np.int64)
    first = np.searchsorted(state["word_row"], np.arange(state["rows"] + 1))
    size = np.diff(first)[state["row"][pv]]
    ends = np.cumsum(size)
    out, lo = [(pv[:0], state["w"][:0])], 0
    while lo < len(pv):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + TEST_ITEMS, "right")))
        no = np.repeat(np.arange(lo, hi), size[lo:hi])
        w = state["w"][first[state["row"][pv[no]]] + np.arange(len(no)) - (ends[no] - size[no] - before)]
        ok = bits[no, place[w] >> 6] >> (place[w] & 63) & 1 == 1
        out.append((pv[no[ok]], w[ok]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def block_guesses(state: dict, lefts: pa.Table) -> dict:
    """``state`` with what the left words' rows settle: of each left word the ``base`` guess and
    its count ``s_base``, the ``help`` guess (-1: none), and the words ``cand`` that may
    follow ``cand_of`` and be the help guess. Base guesses are numbered on after the block's words."""
    words, row, v = state["words"], state["row"], state["v"]
    place = np.full(len(words) + 1, -1)
    place[pc.index_in(lm.column(lefts, "v"), words).to_numpy(zero_copy_only=False)] = np.arange(lefts.num_rows)
    at = place[v]
    tops = lm.column(lefts, "top")
    size = pc.list_value_length(tops).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    flat = tops.flatten()
    top = pc.fill_null(pc.index_in(flat, words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    heads = flat.take(pa.array(first))
    unknown = pc.unique(heads.filter(pa.array(top[first] < 0)))
    names = pa.concat_arrays([words, unknown])
    head = pc.index_in(heads, names).to_numpy(zero_copy_only=False).astype(np.int64)
    s_base = lm.column(lefts, "s_base").to_numpy(zero_copy_only=False)
    found = at >= 0
    guess = {"base": np.full(len(v), -1), "s_base": np.zeros(len(v), np.int64), "help": np.full(len(v), -1)}
    guess["base"][found], guess["s_base"][found] = head[at[found]], s_base[at[found]]
    left, r = np.flatnonzero(found), 0
    open_ = [left[:0]]
    while len(left):
        more = size[at[left]] > r
        open_.append(left[~more])
        left = left[more]
        word = top[first[at[left]] + r]
        hit = _among(row[left], word, state)
        guess["help"][left[hit]] = word[hit]
        left, r = left[~hit], r + 1
    left = np.concatenate(open_)
    maps = lm.column(lefts, "bits")
    left = left[~maps.is_null().to_numpy(zero_copy_only=False)[at[left]]]
    used, own = np.unique(at[left], return_inverse=True)
    bits = maps.take(pa.array(used)).flatten().to_numpy(zero_copy_only=False).reshape(-1, _WORDS)
    # A few left words at once, so that their copies of the bitmaps stay small.
    parts = [_may_follow(left[i:i + 65536], bits[own[i:i + 65536]], state) for i in range(0, len(left), 65536)]
    cand_of, cand = (np.concatenate(x) for x in zip((left[:0], left[:0]), *parts, strict=True))
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy(zero_copy_only=False)] = np.arange(len(names))
    return state | guess | {"cand_of": cand_of, "cand": cand, "rank": rank}


def _first(of: np.ndarray, score: np.ndarray, word: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` places the word of the largest score (ties: the smaller word), or -1."""
    order = np.lexsort((rank[word], -score, of))
    places, at = np.unique(of[order], return_index=True)
    best = np.full(n, -1)
    best[places] = word[order][at]
    return best


def block_hits(state: dict, c: np.ndarray) -> list[np.ndarray]:
    """Per row of a block the columns ``_HITS``. ``c``: the corpus counts of the asked bigrams."""
    n, rank, known = len(state["v"]), state["rank"], state["base"] >= 0
    cand = c[state["cand_at"]]
    some = cand > 0
    late = _first(state["cand_of"][some], cand[some], state["cand"][some], rank, n)
    helped = np.where(state["help"] >= 0, state["help"], np.where(late >= 0, late, state["base"]))
    tuned = _first(np.append(state["own_of"], np.flatnonzero(known)),
                   np.append(c[state["own_at"]] + TUNE_BOOST * state["cp"], state["s_base"][known]),
                   np.append(state["own"], state["base"][known]), rank, n)
    of = state["of"]
    row, k = state["row"][of], state["k"]
    return [np.bincount(row, weights=w, minlength=state["rows"]).astype(np.int64)
            for w in (k, *[k * (state["answer"] == x[of]) for x in (state["base"], helped, tuned)])]


def _by_blocks(pairs: DataFrame, learnt: DataFrame, lefts: DataFrame, key: str, buckets: int) -> DataFrame:
    """``(key, *_HITS)`` of pairs whose keys differ. ``learnt``: the corpus in blocks."""
    held = cut_lineage(_pair_blocks(pairs, key))
    asked = held.select("block", F.explode("lefts").alias("v")).join(lefts, "v").select(
        F.col("block").alias("_of"), "v", "top", "s_base", "bits")

    def guessed(block: pa.Table, rows: pa.Table) -> pa.Table:
        no = block.column("block")[0].as_py()
        state = block_guesses(pickle.loads(block.column("state")[0].as_py()), rows)
        v = state["v"]
        asks, at = np.unique(np.append(v[state["cand_of"]] << 32 | state["cand"], v[state["own_of"]] << 32 | state["own"]),
                             return_inverse=True)
        order, grams, cut = lm.dealt_grams(state["words"], asks >> 32, asks & 0xFFFFFFFF, buckets)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n = len(state["cand"])
        state |= {"cand_at": place[at[:n]], "own_at": place[at[n:]]}
        for gone in ("words", "word_row", "w"):
            del state[gone]
        out = [*lm.packed(no, grams, cut), (no, -1, pickle.dumps(state), None, None)]
        return pa.table([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (
            pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=_GUESSES.names)

    guesses = cut_lineage(held.select("block", "state").groupBy("block").cogroup(asked.groupBy("_of")).applyInArrow(guessed, _GUESSES))
    answers = guesses.where("bucket >= 0").unionByName(learnt).groupBy("bucket").applyInArrow(lm.bucket_totals, lm.ANSWERS)
    answers = answers.where(F.col("block").isNotNull()).select("block", "bucket", "counts")
    texts = held.select("block", "keys").join(guesses.where("bucket = -1").select("block", F.col("grams").alias("state")), "block")
    own = pairs.schema[key]

    def hits(block: pa.Table, rows: pa.Table) -> pa.Table:
        found = block_hits(pickle.loads(block.column("state")[0].as_py()), lm.answered(rows))
        return pa.table([lm.column(block, "keys").flatten(), *[pa.array(x, pa.int64()) for x in found]], names=[key, *_HITS])

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        hits, T.StructType([T.StructField(key, own.dataType), *[T.StructField(c, T.LongType()) for c in _HITS]]))


def _relationally(pairs: DataFrame, cc: DataFrame, lefts: DataFrame, key: str) -> DataFrame:
    """``(key, *_HITS)`` of pairs that share keys: their masks are one text's."""
    long_w = F.length("w") >= MIN_WORD_LEN

    def tokens(rows: DataFrame) -> DataFrame:
        return rows.select(key, tx.tok("gold").alias("g"), tx.tok("predicted").alias("h"))

    tp = tokens(pairs).repartition(key)
    masks = _masks(tp, key).groupBy(key, "v", "answer").agg(F.count(F.lit(1)).alias("k"))
    asked = masks.select(key, "v").distinct()
    asked = split_lookup(asked, lefts, ["v"], ["top", "s_base", "bits"],
                         probe=_masks(tokens(probe_sample(pairs)), key).select("v"))
    words = tp.select(key, F.array_distinct(F.filter("h", lambda w: F.length(w) >= MIN_WORD_LEN)).alias("_w"))
    # ``array_intersect`` keeps the order of its first side.
    asked = cut_lineage(asked.join(words, key).select(
        key, "v", F.get("top", F.lit(0)).alias("w_base"), "s_base",
        F.get(F.array_intersect("top", "_w"), F.lit(0)).alias("w_help"), "bits", "_w").select(
        key, "v", "w_base", "s_base", "w_help", F.when(F.col("w_help").isNull() & F.col("bits").isNotNull(), F.filter(
            "_w", lambda w: F.call_function("getbit", F.get("bits", F.floor(_place(w) / 64).cast("int")), _place(w) % 64) == 1
        )).alias("_c")))

    helping = asked.select(key, "v", F.explode("_c").alias("w"), F.lit(0).cast("long").alias("cp"))
    own = bigrams(pairs, key, "predicted").where(long_w).groupBy(key, "v", "w").agg(F.count(F.lit(1)).alias("cp"))
    own = own.join(asked.select(key, "v"), [key, "v"], "left_semi")
    cand = split_lookup(helping.unionByName(own), cc, ["v", "w"], ["c"],
                        probe=bigrams(probe_sample(pairs), key, "predicted").where(long_w).select("v", "w"))
    helps, boost = F.col("cp") == 0, F.coalesce("c", F.lit(0)) + TUNE_BOOST * F.col("cp")
    best = cand.groupBy(key, "v").agg(
        F.min(F.when(helps & F.col("c").isNotNull(), F.struct((-F.col("c")).alias("s"), F.col("w")))).alias("_help"),
        F.min(F.when(~helps, F.struct((-boost).alias("s"), F.col("w")))).alias("_tune"))
    from_base = F.when(F.col("w_base").isNotNull(), F.struct((-F.col("s_base")).alias("s"), F.col("w_base").alias("w")))
    guesses = asked.join(best, [key, "v"], "left").select(
        key, "v", "w_base", F.coalesce("w_help", F.col("_help")["w"], "w_base").alias("w_help"),
        F.least("_tune", from_base)["w"].alias("w_tune"))

    def hits(c):
        return F.sum(F.when(F.col("answer") == F.col(c), F.col("k")).otherwise(0)).cast("long")
    return masks.join(guesses, [key, "v"]).groupBy(key).agg(
        F.sum("k").alias("masked"), hits("w_base").alias("base_correct"),
        hits("w_help").alias("help_correct"), hits("w_tune").alias("tune_correct"))


def cloze_gain(pairs: DataFrame, corpus: DataFrame, key: str = "pair_id", text: str = "text",
               top: int = TOP) -> DataFrame:
    """``(key, masked, base_correct, help_correct, tune_correct, blanc_help, blanc_tune)`` of every pair.
    ``top`` decides how much is settled without a lookup, never a result."""
    # The corpus counts are the "model": its blocks are made once, added up once for the
    # left words and once for what the pairs ask.
    buckets = math.ceil(estimated_size(corpus.select(text))[1] / lm.BLOCK_BYTES) or 1
    learnt = cut_lineage(lm.gram_blocks(corpus.select(F.lit(None).cast("long").alias("_k"), F.col(text).alias("_train")),
                                        "_k", "_train", True, False, buckets, MIN_WORD_LEN)).drop("keys")
    cc = cut_lineage(learnt.groupBy("bucket").applyInArrow(lm.bucket_bigrams, "v string, w string, c long"))
    once, repeated = split_repeated(pairs, key)
    lefts = left_words(cc, top)
    per = _by_blocks(once, learnt, lefts, key, buckets)
    if repeated is not None:
        per = per.unionByName(_relationally(repeated, cc, lefts, key))
    out = pairs.select(key).join(per, key, "left").fillna(0, ["masked", "base_correct", "help_correct", "tune_correct"])
    mk = F.col("masked").cast("double")
    return out.select(
        key, F.col("masked").cast("long").alias("masked"), "base_correct", "help_correct", "tune_correct",
        tx.r6(F.when(mk > 0, (F.col("help_correct") - F.col("base_correct")) / mk)).alias("blanc_help"),
        tx.r6(F.when(mk > 0, (F.col("tune_correct") - F.col("base_correct")) / mk)).alias("blanc_tune"))
