"""

Re-aimed: the reference embeds tokens with a neural encoder. Here tokens
are looked up in a **given** token-vector table; both metrics come from the
same per-pair cosine matrix:

* ``embedding_match`` (Zhang 2020 form, no idf, no rescaling): P = mean over
  predicted tokens of the best cosine to a gold token, R mirrored, F.
* ``mover_score`` (relaxed word mover's distance, Kusner 2015): distance
  ``d = sqrt(max(2 - 2cos, 0))`` between unit vectors, uniform weights;
  ``rwmd = max(mean_pred min d, mean_gold min d)``, score ``1 - rwmd``. It
  upper-bounds the exact mover score (the relaxation lower-bounds EMD).

Plan: pairs are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash of
their key, and the texts move there once. A block's distinct tokens find their
vectors by joins, in which a token or a vector has at most one row a block however
frequent it is, so no vector is repeated for a pair or a token. A cogroup brings a
block's texts and its distinct vectors together, where the cosine matrices are
products in numpy, blockwise. What moves follows the texts, whatever the number of
vectors; the vector table is never shipped whole to a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import list_codes
from quillmark.operators.aggregates import idf_table
from quillmark.operators.joins import estimated_size

BLOCK_ROWS = 2048
# Text of a block of pairs, which one task holds with the vectors of its tokens.
BLOCK_BYTES = 16 * 1024 * 1024

# A StructType, not a DDL string: workers import this module without a session.
MATCH_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in ("em_p", "em_r", "em_f", "rwmd")])


def token_vec_ids(vocab: DataFrame, slots: Column | int) -> DataFrame:
    """``(token, vec_id)``: vocabulary rank modulo ``slots``, the number of vectors."""
    return vocab.select("token", (F.col("rank") % slots).alias("vec_id"))


def _unit_rows(vecs) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return m / n


def _best_cosines(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise max of ``h @ g.T`` and column-wise max, in row blocks."""
    best_h = np.empty(h.shape[0])
    best_g = np.full(g.shape[0], -np.inf)
    for s in range(0, h.shape[0], BLOCK_ROWS):
        blk = h[s:s + BLOCK_ROWS] @ g.T
        best_h[s:s + BLOCK_ROWS] = blk.max(axis=1)
        np.maximum(best_g, blk.max(axis=0), out=best_g)
    return best_h, best_g


def match_pair(g: np.ndarray, wg: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple:
    """Scores of one pair from the distinct gold / predicted unit vectors and their counts."""
    if len(g) == 0 or len(h) == 0:
        return 0.0, 0.0, 0.0, None
    best_h, best_g = _best_cosines(h, g)
    p = float((wh * best_h).sum() / wh.sum())
    r = float((wg * best_g).sum() / wg.sum())
    f = 0.0 if p + r == 0 else 2 * p * r / (p + r)
    dh = np.sqrt(np.maximum(2.0 - 2.0 * best_h, 0.0))
    dg = np.sqrt(np.maximum(2.0 - 2.0 * best_g, 0.0))
    rwmd = max(float((wh * dh).sum() / wh.sum()), float((wg * dg).sum() / wg.sum()))
    return p, r, f, rwmd


def _summed(row: np.ndarray, item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, item, n)`` with the numbers of equal rows and items added, in order of row."""
    key, inverse = np.unique(row << 32 | item, return_inverse=True)
    return key >> 32, key & 0xFFFFFFFF, np.bincount(inverse, weights=n, minlength=len(key))


def _found(items: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``items`` and of those equal to them in the sorted ``known``, a pair for each."""
    first, last = np.searchsorted(known, items, "left"), np.searchsorted(known, items, "right")
    found = np.repeat(np.arange(len(items)), last - first)
    return found, np.arange(len(found)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[found]


def _vector_counts(row: np.ndarray, tokens: tuple[np.ndarray, np.ndarray], order: np.ndarray, known: np.ndarray,
                   vec: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows, vectors and counts of one side. ``known``: the tokens that have
    a vector, sorted; ``vec[order]`` are their vectors."""
    code, offs = tokens
    r, c, n = _summed(np.repeat(row, np.diff(offs)), code, np.ones(len(code)))
    found, at = _found(c, known)
    r, v, n = _summed(r[found], vec[order[at]], n[found])
    return np.searchsorted(r, np.arange(rows + 1)), v, n


def match_block(keys: list, g: pa.Array, h: pa.Array, tokens: pa.Array, vecs: pa.Array) -> tuple[list[int], list[tuple]]:
    """Per distinct key its first place and its scores. ``g``, ``h``: texts with one space
    between tokens; ``tokens``: the token list of each of ``vecs``."""
    number: dict = {}
    row = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
    places = np.unique(row, return_index=True)[1].tolist()
    own = len(vecs)
    if len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("vectors of different lengths")
    unit = _unit_rows(vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own, -1)) if own else np.zeros((0, 1))
    gc, hc, (known, offs) = list_codes(pc.split_pattern(g, " "), pc.split_pattern(h, " "), tokens)
    vec, order = np.repeat(np.arange(own), np.diff(offs)), np.argsort(known, kind="stable")
    (og, vg, ng), (oh, vh, nh) = (_vector_counts(row, x, order, known[order], vec, len(number)) for x in (gc, hc))
    return places, [match_pair(unit[vg[og[i]:og[i + 1]]], ng[og[i]:og[i + 1]], unit[vh[oh[i]:oh[i + 1]]], nh[oh[i]:oh[i + 1]])
                    for i in range(len(number))]


def _plain(c: str) -> Column:
    # The tokens of ``tx.tok``, a space between them: as short as the text, unlike an array.
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.col(c)), tx.ROUGE_SEPARATOR, " ")), F.lit(""))


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _named(ids: pa.Array) -> list:
    return [tuple(k.values()) if isinstance(k, dict) else k for k in ids.to_pylist()]


def vector_scores(pairs: DataFrame, vec_ids: DataFrame, vectors: DataFrame, key: str = "pair_id",
                  move_texts: bool = True) -> DataFrame:
    """``(key, em_p, em_r, em_f, mover_score)`` for every pair.

    ``vec_ids``: ``(token, vec_id)``; ``vectors``: ``(vec_id, embedding)``.
    Tokens without a vector, or whose vector is null, are dropped.
    ``move_texts=False`` counts a block's distinct tokens where the texts stand; the
    texts then move to the blocks in the cogroup only.
    """
    blocks = math.ceil(estimated_size(pairs.select("gold", "predicted"))[1] / BLOCK_BYTES) or 1
    # A null key finds no scores in the last join.
    texts = pairs.where(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), key, _plain("gold").alias("_g"), _plain("predicted").alias("_h"))
    if move_texts:
        texts = texts.repartition("_block")
    # The key is read in both uses of the exchange, so that Spark sees one.
    words = texts.select("_block", key, F.explode(F.array_distinct(F.split(F.concat_ws(" ", "_g", "_h"), " "))).alias("token"))
    words = words.groupBy("_block", "token").agg(F.max(F.hash(key)).alias("_any"))
    named = words.join(vec_ids, "token").where(F.col("vec_id").isNotNull()).groupBy("_block", "vec_id").agg(
        F.collect_list("token").alias("_tokens"))
    # At most one row a block and vector, so no vector is hot.
    found = named.join(vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding"), "vec_id").select(F.col("_block").alias("_of"), "_tokens", "embedding")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = _column(left, key)
        places, rows = match_block(_named(ids), *(_column(left, c) for c in ("_g", "_h")),
                                   *(_column(right, c) for c in ("_tokens", "embedding")))
        return pa.table([ids.take(pa.array(places, pa.int64())), *[pa.array(x, pa.float64()) for x in zip(*rows, strict=True)]],
                        names=[key, *MATCH_SCHEMA.names])

    scores = texts.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(
        scored, T.StructType([pairs.schema[key], *MATCH_SCHEMA]))
    s = pairs.select(key).join(scores, key, "left")
    return s.select(key,
                    tx.r6(F.coalesce("em_p", F.lit(0.0))).alias("em_p"),
                    tx.r6(F.coalesce("em_r", F.lit(0.0))).alias("em_r"),
                    tx.r6(F.coalesce("em_f", F.lit(0.0))).alias("em_f"),
                    tx.r6(1.0 - F.col("rwmd")).alias("mover_score"))


def embedding_match(pairs: DataFrame, vec_ids: DataFrame, vectors: DataFrame,
                    key: str = "pair_id") -> DataFrame:
    """MET-10: greedy max-cosine precision, recall and F."""
    return vector_scores(pairs, vec_ids, vectors, key).select(key, "em_p", "em_r", "em_f")


def mover_score(pairs: DataFrame, vec_ids: DataFrame, vectors: DataFrame,
                key: str = "pair_id") -> DataFrame:
    """MET-11: ``1 - relaxed word mover's distance``."""
    return vector_scores(pairs, vec_ids, vectors, key).select(key, "mover_score")


IDF_SCHEMA = T.StructType([T.StructField("references", T.LongType()), T.StructField("score", T.DoubleType())])


def moved_by_reference(refs: list[tuple[np.ndarray, np.ndarray]], h: np.ndarray, hw: np.ndarray) -> tuple:
    """References with a score, and the mean of their scores. ``refs``: unit vectors and
    weights of each; ``h``, ``hw``: those of the predicted text."""
    scores = []
    for g, gw in refs if len(h) else []:
        if len(g):
            best_h, best_g = _best_cosines(h, g)
            far_h, far_g = (np.sqrt(np.maximum(2.0 - 2.0 * b, 0.0)) for b in (best_h, best_g))
            scores.append(1.0 - max(hw @ far_h / hw.sum(), gw @ far_g / gw.sum()))
    return len(scores), float(np.mean(scores)) if scores else None


def move_block(keys: list, refs: np.ndarray, sides: np.ndarray, texts: pa.Array, tokens: pa.Array,
               token_sides: np.ndarray, idf: np.ndarray, vecs: pa.Array) -> tuple[list[int], list[tuple]]:
    """Per distinct key its first place and what ``moved_by_reference`` gives. ``texts``: one space
    between tokens, predicted ones of side 1, a ``ref``'s of side 0; ``tokens``: the token list of
    each of ``vecs``, and flat the sides and weights of these."""
    number: dict = {}
    row = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
    places = np.unique(row, return_index=True)[1].tolist()
    # A bag for each key's predicted texts, then its references in order.
    bags, bag = np.unique(np.stack([row, -sides, np.where(sides == 1, 0, refs)], 1), axis=0, return_inverse=True)
    own = len(vecs)
    if len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("vectors of different lengths")
    unit = _unit_rows(vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own, -1)) if own else np.zeros((0, 1))
    (code, offs), (known, of_vec) = list_codes(pc.split_pattern(texts, " "), tokens)
    vec, known = np.repeat(np.arange(own), np.diff(of_vec)), known * 2 + token_sides
    order = np.argsort(known, kind="stable")
    b, c, n = _summed(np.repeat(bag.reshape(-1), np.diff(offs)), code * 2 + np.repeat(sides, np.diff(offs)), np.ones(len(code)))
    found, at = _found(c, known[order])
    b, v, w = _summed(b[found], vec[order[at]], n[found] * idf[order[at]])
    ends = np.searchsorted(b, np.arange(len(bags) + 1))
    weighted = [(unit[v[lo:hi]], w[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    out = []
    cuts = np.searchsorted(bags[:, 0], np.arange(len(number) + 1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        said = bags[lo, 1] == -1   # the key has a predicted text
        out.append(moved_by_reference(weighted[lo + said:hi], *(weighted[lo] if said else (unit[:0], w[:0]))))
    return places, out


def mover_score_idf(pairs: DataFrame, refs: DataFrame, vec_ids: DataFrame, vectors: DataFrame,
                    key: str = "pair_id") -> DataFrame:
    """MET-11 with idf weights and several references: ``(key, references, mover_score_idf)``.

    ``pairs``: ``(key, predicted)``; ``refs``: ``(key, ref_id, gold)``, any number a pair.
    A token weighs its count times its idf, taken over the references for gold and over the
    predicted texts for predicted tokens, and each side's weights are normalised.
    The score is the mean over the references; a reference without a weighted vector
    has none, and a pair without any is null. Null texts have no tokens.
    """
    gold = refs.select(key, F.col("ref_id").cast("long").alias("ref"), "gold")
    weights = None
    for side, table, text in ((0, gold, "gold"), (1, pairs, "predicted")):
        some = idf_table(table, key, text).where("idf > 0").select(F.lit(side).alias("side"), "token", "idf")
        weights = some if weights is None else weights.unionByName(some)
    weights = weights.join(vec_ids, "token").where(F.col("vec_id").isNotNull())
    texts = gold.select(key, "ref", F.lit(0).alias("side"), F.col("gold").alias("_t")).unionByName(
        pairs.select(key, F.lit(0).cast("long").alias("ref"), F.lit(1).alias("side"), F.col("predicted").alias("_t")))
    blocks = math.ceil(estimated_size(texts.select("_t"))[1] / BLOCK_BYTES) or 1
    # A null key finds no scores in the last join.
    texts = texts.where(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), key, "ref", "side", _plain("_t").alias("_t")).repartition("_block")
    # Key and reference are read in both uses of the exchange, so that Spark sees one.
    words = texts.select("_block", key, "ref", "side", F.explode(F.array_distinct(F.split("_t", " "))).alias("token"))
    words = words.groupBy("_block", "side", "token").agg(F.max(F.hash(key, "ref")).alias("_any")).where(F.col("_any").isNotNull())
    named = words.join(weights, ["side", "token"]).groupBy("_block", "vec_id").agg(
        F.collect_list(F.struct("token", "side", "idf")).alias("_w"))
    # At most one row a block and vector, so no vector is hot.
    found = named.join(vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding"), "vec_id").select(
        F.col("_block").alias("_of"), *[F.col(f"_w.{c}").alias(f"_{c}") for c in ("token", "side", "idf")], "embedding")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tokens = _column(left, key), _column(right, "_token")
        # A null name is one reference.
        ref, side = (_column(left, c).cast(pa.int64()).fill_null(-2 ** 63).to_numpy(zero_copy_only=False) for c in ("ref", "side"))
        flat = (_column(right, c).flatten().to_numpy(zero_copy_only=False) for c in ("_side", "_idf"))
        places, rows = move_block(_named(ids), ref, side, _column(left, "_t"), tokens, *flat, _column(right, "embedding"))
        n, score = zip(*rows, strict=True) if rows else ((), ())
        return pa.table([ids.take(pa.array(places, pa.int64())), pa.array(n, pa.int64()), pa.array(score, pa.float64())],
                        names=[key, *IDF_SCHEMA.names])

    scores = texts.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(
        scored, T.StructType([pairs.schema[key], *IDF_SCHEMA]))
    return pairs.select(key).join(scores, key, "left").select(
        key, F.coalesce("references", F.lit(0)).cast("long").alias("references"),
        tx.r6(F.col("score")).alias("mover_score_idf"))
