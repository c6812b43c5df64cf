
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.counting import ngram_kinds

# Generation bounds audited by DQ-3 and the n-gram size audited by DQ-2
# (fixed values of the generation settings).
MIN_LENGTH = 100
MAX_LENGTH = 1024
NO_REPEAT_NGRAM = 3


class MissingSplitError(ValueError):
    pass


def require_splits(df: DataFrame, required: list[str], col: str = "split",
                   strict: bool = False) -> DataFrame:
    """DQ-1: required splits that have no rows (report form).

    The required list is a literal table of a few rows; the present splits
    come from a partial distinct. ``strict=True`` raises when any is missing.
    """
    spark = df.sparkSession
    req = spark.createDataFrame([(s,) for s in required], f"{col} string")
    present = df.select(col).distinct()
    missing = req.join(present, col, "left_anti")
    if strict and not missing.isEmpty():
        raise MissingSplitError("missing splits: " + ", ".join(
            r[col] for r in missing.limit(len(required)).collect()))
    return missing


def _ngram_kinds(n: int):
    """Arrow UDF: n-grams and distinct n-grams of a lower-cased text."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def kinds(texts: pa.Array) -> pa.Array:
        return pa.array(ngram_kinds(texts, n).tolist(), pa.list_(pa.int64()))
    return kinds


def repeat_ngram_rate(df: DataFrame, key: str, text: str, n: int = NO_REPEAT_NGRAM) -> DataFrame:
    """DQ-2: ``1 - distinct/total`` n-grams per text (NULL without n-grams).

    Row-local: a batch's n-grams are numbered and counted in numpy where the
    texts stand, no n-gram is a string, no shuffle. A null text has none.
    """
    g = df.select(key, _ngram_kinds(n)(F.coalesce(F.lower(text), F.lit(""))).alias("_g"))
    total, distinct = F.get("_g", F.lit(0)), F.get("_g", F.lit(1))
    rate = F.when(total > 0, 1.0 - distinct / total)
    return g.select(key, total.alias("ngrams"), tx.r6(rate).alias("repeat_rate"))


def length_bounds(df: DataFrame, text: str, by: str = "system",
                  lo: int = MIN_LENGTH, hi: int = MAX_LENGTH) -> DataFrame:
    """DQ-3: token counts against the generation bounds, counted per group."""
    n = F.size(tx.tok(text))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when((n >= lo) & (n <= hi), 1).otherwise(0)).cast("long").alias("within"),
        F.sum(F.when(n < lo, 1).otherwise(0)).cast("long").alias("too_short"),
        F.sum(F.when(n > hi, 1).otherwise(0)).cast("long").alias("too_long"))
