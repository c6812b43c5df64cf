"""Counting metrics over word n-grams: ROUGE-N, sentence and corpus BLEU

Matches are a function of one pair's two texts: an Arrow UDF counts the n-grams
of a whole batch of pairs in numpy (:mod:`quillmark.functions.counting`) where the
texts stand, so neither texts nor n-grams are exchanged, sorted or spilled. Only
rows that share a key meet: their n-grams are exploded and counted together
(:func:`ngram_overlap`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import best_clipped_matches, clipped_matches, list_codes, text_matches
from quillmark.operators.joins import split_repeated
from quillmark.operators.tokens import tokenised_pairs


def _tag(n: int):
    # one-argument lambda: PySpark passes the element index to two-argument ones
    return lambda x: F.struct(F.lit(n).alias("n"), x.alias("gram"))


def _tagged_ngrams(toks: Column, ns, gram_fn=tx.ngrams) -> Column:
    return F.concat(*[F.transform(gram_fn(toks, n), _tag(n)) for n in ns])


def ngram_overlap(tp: DataFrame, ns, key: str = "pair_id", extra: tuple[str, ...] = (),
                  gram_fn=tx.ngrams, size_fn=F.size) -> DataFrame:
    """``(key, lg, lh, *extra, ov_<n>...)`` for every pair of a tokenised-pairs
    frame: token counts of both sides and clipped n-gram matches
    ``Σ min(c_gold, c_pred)`` for every n.

    One pass: the per-pair lengths ride along as group keys (they are
    functions of the key), so no join back to the pair table is needed and
    the plan has a single exchange — the texts' move to ``pair_id``.
    A side without n-grams yields one null row (``inline_outer``), so every
    pair survives the aggregation.
    """
    carry = ["lg", "lh", *extra]
    base = tp.select(key, size_fn("g").alias("lg"), size_fn("h").alias("lh"), *extra, "g", "h")
    sides = base.select(key, *carry, F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("g").alias("toks")),
        F.struct(F.lit(1).alias("side"), F.col("h").alias("toks")))))
    grams = sides.select(key, *carry, "side", F.inline_outer(_tagged_ngrams(F.col("toks"), ns, gram_fn)))
    real = F.col("gram").isNotNull()
    counts = grams.groupBy(key, *carry, "n", "gram").agg(
        F.sum(F.when(real & (F.col("side") == 0), 1).otherwise(0)).alias("cg"),
        F.sum(F.when(real & (F.col("side") == 1), 1).otherwise(0)).alias("ch"))
    m = F.least("cg", "ch")
    return counts.groupBy(key, *carry).agg(*[
        F.sum(F.when(F.col("n") == n, m).otherwise(0)).cast("long").alias(f"ov_{n}") for n in ns])


def _word_matches(order: int):
    """Arrow UDF: clipped matches of two token arrays for n = 1..order."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def matches(g: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(clipped_matches(*list_codes(g, h), order).tolist(), pa.list_(pa.int64()))
    return matches


def _text_matches(order: int):
    """Arrow UDF: tokens (``tx.tok``) of two lower-cased texts and their clipped matches for n = 1..order."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def matches(g: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(text_matches(g, h, order).tolist(), pa.list_(pa.int64()))
    return matches


def word_overlap(pairs: DataFrame, tokenizer, ns, key: str = "pair_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """:func:`ngram_overlap` of word n-grams, with no exchange but that of the keys:
    pairs are counted where they stand, rows that share a key with another relationally."""
    once, repeated = split_repeated(pairs, key)
    if tokenizer is tx.tok:
        # Texts go to numpy as they are: no token is a string of the JVM's.
        t = once.select(key, *extra, *[F.lower(c).alias(a) for c, a in (("gold", "g"), ("predicted", "h"))])
        m = t.select(key, *extra, F.col("g").isNotNull().alias("_g"), F.col("h").isNotNull().alias("_h"),
                     _text_matches(max(ns))(F.coalesce("g", F.lit("")), F.coalesce("h", F.lit(""))).alias("_m"))
        m = m.select(key, *extra, F.slice("_m", 3, max(ns)).alias("_m"),
                     *[F.when(F.col(f"_{a}"), F.get("_m", F.lit(i))).cast("int").alias(f"l{a}") for i, a in enumerate("gh")])
    else:
        t = once.select(key, *extra, tokenizer("gold").alias("g"), tokenizer("predicted").alias("h"))
        m = t.select(key, F.size("g").alias("lg"), F.size("h").alias("lh"), *extra,
                     _word_matches(max(ns))("g", "h").alias("_m"))
    out = m.select(key, "lg", "lh", *extra, *[F.get("_m", F.lit(n - 1)).alias(f"ov_{n}") for n in ns])
    if repeated is not None:
        out = out.unionByName(ngram_overlap(tokenised_pairs(repeated, tokenizer, key, extra=extra), ns, key, extra))
    return out


def rouge_n(pairs: DataFrame, ns=(1, 2), key: str = "pair_id", tokenizer=tx.tok,
            places: int | None = 6) -> DataFrame:
    """MET-1: ROUGE-N precision, recall, F for each n (no stemming).

    ``places=None`` keeps full precision (for scores that are averaged later).
    """
    rnd = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    j = word_overlap(pairs, tokenizer, ns, key)
    cols = []
    for n in ns:
        o = F.col(f"ov_{n}")
        p = o / F.greatest(F.col("lh") - (n - 1), F.lit(1))
        r = o / F.greatest(F.col("lg") - (n - 1), F.lit(1))
        cols += [rnd(p).alias(f"rouge{n}_p"), rnd(r).alias(f"rouge{n}_r"),
                 rnd(tx.f_measure(p, r)).alias(f"rouge{n}_f")]
    return j.select(key, *cols)


BLEU_ORDER = 4


def bleu_stats(pairs: DataFrame, key: str = "pair_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per-pair BLEU sufficient statistics ``(key, m1..m4, t1..t4, hyp_len, ref_len)``:
    clipped matches, possible n-grams and 13a lengths."""
    ns = range(1, BLEU_ORDER + 1)
    j = word_overlap(pairs, tx.tok13a, ns, key, extra)
    return j.select(key, *extra, F.col("lh").cast("long").alias("hyp_len"),
                    F.col("lg").cast("long").alias("ref_len"),
                    *[F.col(f"ov_{n}").alias(f"m{n}") for n in ns],
                    *[F.greatest(F.col("lh") - (n - 1), F.lit(0)).cast("long").alias(f"t{n}") for n in ns])


def bleu_scores(match, total, hyp_len: Column, ref_len: Column) -> list[Column]:
    """BLEU's score columns from ``match(n)``, ``total(n)`` and the lengths:
    no smoothing, brevity penalty on lengths."""
    ns = range(1, BLEU_ORDER + 1)
    ps = {n: tx.safe_div(match(n), total(n)) for n in ns}
    all_pos = None
    for n in ns:
        c = ps[n] > 0
        all_pos = c if all_pos is None else (all_pos & c)
    geo = F.when(all_pos, F.exp(sum(F.log(F.when(ps[n] > 0, ps[n]).otherwise(F.lit(1.0))) for n in ns)
                               / BLEU_ORDER)).otherwise(F.lit(0.0))
    ratio = tx.safe_div(hyp_len, ref_len)
    bp = (F.when(hyp_len == 0, F.lit(0.0))
           .when(ratio > 1, F.lit(1.0))
           .when(ratio == 0, F.lit(0.0))
           .otherwise(F.exp(1.0 - 1.0 / F.when(ratio == 0, F.lit(1.0)).otherwise(ratio))))
    return [tx.r6(geo * bp).alias("bleu"),
            *[tx.r6(ps[n]).alias(f"p{n}") for n in ns],
            tx.r6(bp).alias("brevity_penalty"),
            tx.r6(ratio).alias("length_ratio"),
            hyp_len.alias("translation_length"),
            ref_len.alias("reference_length")]


def bleu_from_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """BLEU from (summed) statistics."""
    return df.select(*keep, *bleu_scores(lambda n: F.col(f"m{n}"), lambda n: F.col(f"t{n}"),
                                         F.col("hyp_len"), F.col("ref_len")))


def bleu(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """MET-5: sentence BLEU of each pair (13a tokens, case-sensitive)."""
    return bleu_from_stats(bleu_stats(pairs, key), [key])


def bleu_corpus(pairs: DataFrame, by: str | None = "system", key: str = "pair_id") -> DataFrame:
    """MET-6: corpus BLEU — statistics summed over the group *before* the ratio.

    The sums are a partial aggregation, so a system holding most pairs is
    combined map-side and never lands whole in one task.
    """
    extra = (by,) if by else ()
    st = bleu_stats(pairs, key, extra)
    ns = range(1, BLEU_ORDER + 1)
    sums = [F.sum(c).cast("long").alias(c) for c in
            ["hyp_len", "ref_len"] + [f"m{n}" for n in ns] + [f"t{n}" for n in ns]]
    g = st.groupBy(by).agg(*sums) if by else st.groupBy().agg(*sums)
    return bleu_from_stats(g, [by] if by else [])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _best_matches(sides: pa.Array, toks: pa.Array) -> pa.Array:
    lists = np.asarray(toks.offsets, np.int64) - toks.offsets[0].as_py()
    found = best_clipped_matches(sides.flatten().to_numpy(zero_copy_only=False), lists, list_codes(toks.flatten())[0], BLEU_ORDER)
    return pa.array(found.tolist(), pa.list_(pa.int64()))


def bleu_multi_ref(hyps: DataFrame, refs: DataFrame, key: str = "pair_id",
                   ref_key: str = "ref_id") -> DataFrame:
    """MET-5 with several references per hypothesis: each n-gram count is
    clipped by its maximum count over the references, and the reference
    length is the shortest reference's.

    ``hyps``: (key, predicted); ``refs``: (key, ref_key, gold). The texts move to
    ``key`` once, as they are; a key's token arrays are gathered in one row, and its
    n-grams are counted in numpy and never leave the task.
    """
    ns = range(1, BLEU_ORDER + 1)
    h = hyps.select(key, F.lit(-1).cast("long").alias("_side"), F.col("predicted").alias("_t"))
    r = refs.select(key, F.col(ref_key).cast("long").alias("_side"), F.col("gold").alias("_t"))
    toks = h.unionByName(r).repartition(key).select(key, "_side", tx.tok13a("_t").alias("_t"))
    st = toks.groupBy(key).agg(
        F.max(F.when(F.col("_side") == -1, F.size("_t"))).cast("long").alias("hyp_len"),
        F.min(F.when(F.col("_side") >= 0, F.size("_t"))).cast("long").alias("ref_len"),
        F.collect_list(F.when(F.col("_side").isNotNull() & F.col("_t").isNotNull(), F.struct("_side", "_t"))).alias("_l"))
    st = st.select(key, "hyp_len", "ref_len", _best_matches("_l._side", "_l._t").alias("_m"))
    # No key equals a null one: its matches are not found.
    st = st.select(
        key, "hyp_len", "ref_len",
        *[F.when(F.col(key).isNull(), 0).otherwise(F.get("_m", F.lit(n - 1))).cast("long").alias(f"m{n}") for n in ns],
        *[F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)).cast("long").alias(f"t{n}") for n in ns])
    return bleu_from_stats(st, [key])
