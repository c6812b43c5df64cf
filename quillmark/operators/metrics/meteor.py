"""

The exact alignment is a function of one pair's two token lists: it is made where the
texts stand, a batch of pairs at once in numpy (:func:`~quillmark.functions.counting.aligned`).
With further stages, and for rows that share a key, it is made of relational operations
inside the ``pair_id`` partitioning: occurrences of a token are numbered from the end on each side
(``row_number``), the k-th from the end on one side pairs with the k-th
from the end on the other (equi-join on ``(pair_id, token, k)``), and chunks
are counted with ``lag`` over the matches in predicted order. Every window
is partitioned by the pair (plus token), i.e. bounded by one row's text.

Stages: exact, then (optionally) Porter stems on the tokens left unmatched
(stemmed inside the task by an Arrow UDF — no vocabulary shuffle), then
(optionally) a user-supplied synonym table joined on the token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import aligned, list_codes
from quillmark.operators.joins import split_repeated
from quillmark.operators.tokens import side_tokens, tokenised_pairs

ALPHA = 0.9
BETA = 3.0
GAMMA = 0.5


def meteor_score(matches: Column, chunks: Column, lh: Column, lg: Column, alpha: float = ALPHA,
                 beta: float = BETA, gamma: float = GAMMA) -> Column:
    """The score of an alignment from its counts and the texts' token counts."""
    m = matches.cast("double")
    p = m / F.greatest(lh, F.lit(1))
    r = m / F.greatest(lg, F.lit(1))
    fmean = F.when(m == 0, F.lit(0.0)).otherwise(p * r / (alpha * p + (1 - alpha) * r))
    return F.when(m == 0, F.lit(0.0)).otherwise(fmean * (1 - gamma * F.pow(chunks / m, beta)))


def _stage_matches(occ: DataFrame, key: str, col: str) -> DataFrame:
    """``(key, hpos, gpos)`` matches of one stage on ``col``."""
    w = Window.partitionBy(key, "side", col).orderBy(F.col("pos").desc())
    k = occ.withColumn("_k", F.row_number().over(w))
    g = k.where(F.col("side") == 0).select(key, col, "_k", F.col("pos").alias("gpos"))
    h = k.where(F.col("side") == 1).select(key, col, "_k", F.col("pos").alias("hpos"))
    return h.join(g, [key, col, "_k"]).select(key, "hpos", "gpos")


def _unmatched(occ: DataFrame, m: DataFrame, key: str) -> DataFrame:
    used = m.select(key, F.lit(0).alias("side"), F.col("gpos").alias("pos")).unionByName(
        m.select(key, F.lit(1).alias("side"), F.col("hpos").alias("pos")))
    return occ.join(used, [key, "side", "pos"], "left_anti")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _alignment(g: pa.Array, h: pa.Array) -> pa.Array:
    return pa.array(np.stack(aligned(*list_codes(g, h)), axis=1).tolist(), pa.list_(pa.int64()))


def _exact_meteor(pairs: DataFrame, key: str, alpha: float, beta: float, gamma: float) -> DataFrame:
    t = pairs.select(key, tx.tok("gold").alias("g"), tx.tok("predicted").alias("h"))
    n = t.select(key, F.size("g").alias("lg"), F.size("h").alias("lh"), _alignment("g", "h").alias("_a"))
    # No key equals a null one: its matches are not found.
    n = n.select(key, "lg", "lh", F.when(F.col(key).isNull(), 0).otherwise(F.get("_a", F.lit(0))).alias("m"),
                 F.get("_a", F.lit(1)).alias("chunks"))
    score = meteor_score(F.col("m"), F.col("chunks"), F.col("lh"), F.col("lg"), alpha, beta, gamma)
    return n.select(key, tx.r6(score).alias("meteor"))


def meteor(pairs: DataFrame, key: str = "pair_id", stem_stage: bool = False,
           synonyms: DataFrame | None = None,
           alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """``(key, meteor)``: exact stage; ``stem_stage`` adds Porter stems on the
    still unmatched tokens; ``synonyms`` (``token``, ``synset``: tokens sharing
    a synset are synonyms, a user table) adds a last stage on what is left."""
    first = None
    if not stem_stage and synonyms is None:
        once, pairs = split_repeated(pairs, key)
        first = _exact_meteor(once, key, alpha, beta, gamma)
        if pairs is None:
            return first
    tp = tokenised_pairs(pairs, tx.tok, key)
    occ = side_tokens(tp, key)
    m = _stage_matches(occ, key, "token")
    if stem_stage:
        from quillmark.operators.metrics.lcs import stem_words
        rest = _unmatched(occ, m, key).select(key, "side", "pos", stem_words("token").alias("stem"))
        m = m.unionByName(_stage_matches(rest, key, "stem"))
    if synonyms is not None:
        rest = _unmatched(occ, m, key).join(synonyms.select("token", "synset"), "token")
        # A token in several synsets counts once: by the first that the other side has too.
        shared = rest.groupBy(key, "synset").agg(F.count_distinct("side").alias("_s")).where("_s = 2")
        one = rest.join(shared.select(key, "synset"), [key, "synset"]).groupBy(key, "side", "pos").agg(
            F.min("synset").alias("synset"))
        m = m.unionByName(_stage_matches(one, key, "synset"))
    w = Window.partitionBy(key).orderBy("hpos")
    brk = F.when((F.col("hpos") - F.lag("hpos").over(w) == 1)
                 & (F.col("gpos") - F.lag("gpos").over(w) == 1), 0).otherwise(1)
    per = m.withColumn("_b", brk).groupBy(key).agg(
        F.count(F.lit(1)).alias("m"), F.sum("_b").alias("chunks"))
    lens = tp.select(key, F.size("g").alias("lg"), F.size("h").alias("lh"))
    j = lens.join(per, key, "left")
    score = meteor_score(F.coalesce("m", F.lit(0)), F.col("chunks"), F.col("lh"), F.col("lg"), alpha, beta, gamma)
    out = j.select(key, tx.r6(score).alias("meteor"))
    return out if first is None else first.unionByName(out)
