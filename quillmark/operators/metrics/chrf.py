"""

Order 6, β = 2, whitespace removed, case-sensitive, no word n-grams.

chrF is a pure function of one pair's two strings, so it runs row-local: an
Arrow UDF counts the character n-grams of a whole batch of pairs in numpy
(:mod:`quillmark.functions.counting`), and the score is a JVM expression of
the counts — no explode, no shuffle. The exploded relational form is kept in
``chrf_relational`` for comparison.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import char_codes, clipped_matches
from quillmark.operators.metrics.overlap import ngram_overlap
from quillmark.operators.tokens import tokenised_pairs

CHAR_ORDER = 6
BETA = 2.0


@F.arrow_udf(T.ArrayType(T.LongType()))
def _char_matches(g: pa.Array, h: pa.Array) -> pa.Array:
    return pa.array(clipped_matches(char_codes(g), char_codes(h), CHAR_ORDER).tolist(), pa.list_(pa.int64()))


def chrf_score(ov, lg: Column, lh: Column, order: int = CHAR_ORDER, beta: float = BETA) -> Column:
    """chrF (0-100) from clipped matches ``ov(n)`` and character counts."""
    ns = range(1, order + 1)
    eff = F.least(lg, lh)
    n_eff = F.least(eff, F.lit(order))
    p_sum = sum(F.when(eff >= n, ov(n) / (lh - (n - 1))).otherwise(F.lit(0.0)) for n in ns)
    r_sum = sum(F.when(eff >= n, ov(n) / (lg - (n - 1))).otherwise(F.lit(0.0)) for n in ns)
    p = p_sum / F.greatest(n_eff, F.lit(1))
    r = r_sum / F.greatest(n_eff, F.lit(1))
    b2 = beta * beta
    return F.when((n_eff == 0) | ((p + r) == 0), F.lit(0.0)).otherwise(100.0 * (1 + b2) * p * r / (b2 * p + r))


def chrf(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``(key, chrf)``: per order n present on both sides, ``P_n`` and ``R_n``;
    P and R averaged over those orders; ``100 (1+β²)PR / (β²P + R)``. A null
    text counts as empty."""
    def stream(c):
        return tx.no_whitespace(F.coalesce(F.col(c), F.lit("")))
    s = pairs.select(key, stream("gold").alias("g"), stream("predicted").alias("h"))
    m = s.select(key, F.length("g").alias("lg"), F.length("h").alias("lh"), _char_matches("g", "h").alias("m"))
    return m.select(key, tx.r6(chrf_score(lambda n: F.col("m")[n - 1], F.col("lg"), F.col("lh"))).alias("chrf"))


def char_ngrams(s, n: int) -> "F.Column":
    """Array of the character n-grams of a (column) string, by ``substring``."""
    return F.when(F.length(s) >= n, F.transform(
        F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, n))
    ).otherwise(F.array().cast("array<string>"))


def chrf_relational(pairs: DataFrame, key: str = "pair_id", order: int = CHAR_ORDER,
                    beta: float = BETA) -> DataFrame:
    """The same score as exploded character n-gram counts (JVM only)."""
    ns = range(1, order + 1)
    ov = ngram_overlap(tokenised_pairs(pairs, tx.no_whitespace, key), ns, key,
                       gram_fn=char_ngrams, size_fn=F.length)
    return ov.select(key, tx.r6(chrf_score(lambda n: F.col(f"ov_{n}"), F.col("lg"), F.col("lh"), order, beta)).alias("chrf"))
