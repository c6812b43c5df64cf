"""

All are partial (map-side combined) aggregations: a system or split that
holds most rows is reduced inside each input task before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx

_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def mean_scores(df: DataFrame, by: str | None = "system", exclude=("pair_id",)) -> DataFrame:
    """AGG-1: mean of every numeric score column (text columns skipped)."""
    cols = numeric_columns(df, exclude=set(exclude) | ({by} if by else set()))
    aggs = [tx.r6(F.avg(c)).alias(f"mean_{c}") for c in cols]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def sample_counts(df: DataFrame, max_samples: int, by: str = "split") -> DataFrame:
    """AGG-3: ``min(max_samples, rows)`` per split."""
    return df.groupBy(by).agg(
        F.least(F.count(F.lit(1)), F.lit(max_samples).cast("long")).alias("samples"))


def corpus_mean(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """AGG-4: mean of pair scores (sum / number of pairs)."""
    aggs = [F.count(F.lit(1)).alias("pairs")] + [tx.r6(F.avg(c)).alias(f"corpus_{c}") for c in cols]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def multi_reference_mean(scores: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """AGG-5: one score row per (hypothesis, reference) -> mean per hypothesis."""
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("references"),
                                   *[tx.r6(F.avg(c)).alias(f"mean_{c}") for c in cols])


def idf_table(docs: DataFrame, key: str, text: str, tokenizer=tx.tok) -> DataFrame:
    """AGG-6: ``(token, df, idf)`` with ``idf = ln((N + 1) / (df + 1))``.

    Tokens are made distinct per document inside the row (``array_distinct``),
    so the only shuffle is the partial ``count`` by token. ``N`` is a scalar
    subquery, evaluated once.
    """
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    t = docs.select(F.explode(F.array_distinct(tokenizer(text))).alias("token"))
    g = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return g.select("token", "df", tx.r6(F.log((n_docs + 1.0) / (F.col("df") + 1.0))).alias("idf"))


def leaderboard(df: DataFrame, score: str, by: str = "system") -> DataFrame:
    """AGG-7: per-system mean, sample std-dev and count, ranked by the mean.

    The rank runs on the aggregated table (one row per system).
    """
    g = df.groupBy(by).agg(tx.r6(F.avg(score)).alias("mean"),
                           tx.r6(F.stddev_samp(score)).alias("std"),
                           F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean").desc())))
