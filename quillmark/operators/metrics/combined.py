"""

Scores that are functions of a pair's two texts (ROUGE, BLEU, METEOR, chrF) are
counted in one Arrow pass where the texts stand; the formulas are JVM
expressions of those counts. Perplexity looks up bigrams, so only these travel;
embedding match moves the texts to blocks. The texts move to ``keys``, and the few
numbers of the other metrics are joined to them there. A metric whose tables
are not given is a column of NULLs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import aligned, char_codes, clipped_matches, list_codes
from quillmark.operators.metrics import lm, vectors
from quillmark.operators.metrics.chrf import CHAR_ORDER, chrf_score
from quillmark.operators.metrics.lcs import lcs_length
from quillmark.operators.metrics.meteor import meteor_score
from quillmark.operators.metrics.overlap import BLEU_ORDER, bleu_scores
from quillmark.operators.pairs import flatten_scores

_COUNTS = T.StructType([
    T.StructField("words", T.ArrayType(T.LongType())), T.StructField("lcs", T.LongType()),
    T.StructField("bleu", T.ArrayType(T.LongType())), T.StructField("matches", T.LongType()),
    T.StructField("chunks", T.LongType()), T.StructField("chars", T.ArrayType(T.LongType()))])


@F.arrow_udf(_COUNTS)
def _pair_counts(g: pa.Array, h: pa.Array, g13: pa.Array, h13: pa.Array, gc: pa.Array, hc: pa.Array) -> pa.Array:
    a, b = list_codes(g, h)
    a13, b13 = list_codes(g13, h13)
    matches, chunks = aligned(a, b)
    lcs = [lcs_length(x, y) for x, y in zip(*(np.split(c.astype(object), o[1:-1]) for c, o in (a, b)), strict=True)] \
        if len(g) else []
    longs = pa.list_(pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(clipped_matches(a, b, 2).tolist(), longs), pa.array(lcs, pa.int64()),
         pa.array(clipped_matches(a13, b13, BLEU_ORDER).tolist(), longs), pa.array(matches, pa.int64()),
         pa.array(chunks, pa.int64()),
         pa.array(clipped_matches(char_codes(gc), char_codes(hc), CHAR_ORDER).tolist(), longs)],
        names=[f.name for f in _COUNTS])


def _prf(match: Column, lh: Column, lg: Column, name: str) -> list[Column]:
    p, r = tx.safe_div(match, lh), tx.safe_div(match, lg)
    return [tx.r6(p).alias(f"{name}_p"), tx.r6(r).alias(f"{name}_r"), tx.r6(tx.f_measure(p, r)).alias(f"{name}_f")]


def pair_local_scores(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``gold``, ``predicted`` and the structs ``rouge``, ``bleu``,
    ``meteor``, ``chrf`` of every row; no exchange. Null texts count as empty."""
    gold, pred = (F.coalesce(F.col(c), F.lit("")) for c in ("gold", "predicted"))
    toks = pairs.select(
        *keep, "gold", "predicted", tx.tok(gold).alias("_g"), tx.tok(pred).alias("_h"),
        tx.tok13a(gold).alias("_g13"), tx.tok13a(pred).alias("_h13"),
        tx.no_whitespace(gold).alias("_gc"), tx.no_whitespace(pred).alias("_hc"))
    n = toks.select(
        *keep, "gold", "predicted", *[F.size(f"_{c}").alias(f"_l{c}") for c in ("g", "h", "g13", "h13")],
        *[F.length(f"_{c}").alias(f"_l{c}") for c in ("gc", "hc")],
        _pair_counts("_g", "_h", "_g13", "_h13", "_gc", "_hc").alias("_c"))
    lg, lh = F.col("_lg"), F.col("_lh")
    c = F.col("_c")
    rouge = [x for k in (1, 2) for x in _prf(c["words"][k - 1], F.greatest(lh - (k - 1), F.lit(1)),
                                             F.greatest(lg - (k - 1), F.lit(1)), f"rouge{k}")]
    rouge += _prf(c["lcs"], lh, lg, "rougeL")
    bleu = bleu_scores(lambda k: c["bleu"][k - 1], lambda k: F.greatest(F.col("_lh13") - (k - 1), F.lit(0)).cast("long"),
                       F.col("_lh13").cast("long"), F.col("_lg13").cast("long"))
    return n.select(
        *keep, "gold", "predicted", F.struct(*rouge).alias("rouge"), F.struct(*bleu).alias("bleu"),
        F.struct(tx.r6(meteor_score(c["matches"], c["chunks"], lh, lg)).alias("meteor")).alias("meteor"),
        F.struct(tx.r6(chrf_score(lambda k: c["chars"][k - 1], F.col("_lgc"), F.col("_lhc"))).alias("chrf")).alias("chrf"))


def nested_scores(pairs: DataFrame, keys: tuple[str, ...] = ("system", "pair_id"), train: DataFrame | None = None,
                  vec_ids: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """One struct column a metric family beside ``keys``, ``gold`` and ``predicted``;
    ``keys`` are unique, a null among them is a value like others."""
    keyed = pairs.select(F.struct(*keys).alias("_k"), *keys, "gold", "predicted")
    base = pair_local_scores(keyed, ["_k", *keys]).repartition("_k")
    if train is not None:
        ppl = lm.lm_perplexity(train, keyed.select("_k", "predicted"), "_k", "predicted")
        base = base.join(ppl.select("_k", F.struct("n_tokens", "perplexity").alias("perplexity")), "_k", "left")
    else:
        base = base.withColumn("perplexity", F.lit(None).cast("struct<n_tokens: bigint, perplexity: double>"))
    if vec_ids is not None and embeddings is not None:
        em = vectors.vector_scores(keyed, vec_ids, embeddings, "_k", move_texts=False)
        base = base.join(em.select("_k", F.struct("em_p", "em_r", "em_f").alias("bert")), "_k", "left")
    else:
        base = base.withColumn("bert", F.lit(None).cast("struct<em_p: double, em_r: double, em_f: double>"))
    return base.select(*keys, "gold", "predicted", "rouge", "bert", "bleu", "meteor", "chrf", "perplexity")


def all_metrics(pairs: DataFrame, keys: tuple[str, ...] = ("system", "pair_id"), **tables: DataFrame) -> DataFrame:
    """Every metric of every pair in one flat row, with the texts (see :func:`nested_scores`)."""
    return flatten_scores(nested_scores(pairs, keys, **tables))
