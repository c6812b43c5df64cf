"""Pair-table operators: projections, filters, joins, unions, limits
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx


class AlignmentError(ValueError):
    """Raised by strict :func:`check_alignment` when a key has only one side."""


def select_pair_columns(df: DataFrame, with_transcript: bool = False,
                        key: str = "pair_id") -> DataFrame:
    """PRJ-1: keep the key, ``gold``, ``predicted`` (and ``transcript``).

    A missing column raises an analysis error, as the reference's lookup does.
    """
    cols = [key, "gold", "predicted"] + (["transcript"] if with_transcript else [])
    return df.select(*cols)


def optional_transcript(df: DataFrame) -> DataFrame:
    """PRJ-2: ``transcript`` if the column exists, else NULL per row, plus
    ``has_transcript`` (non-null and non-empty) deciding the scoring branch."""
    t = F.col("transcript") if "transcript" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("transcript", t)
    return out.withColumn("has_transcript",
                          t.isNotNull() & (F.length(F.coalesce(t, F.lit(""))) > 0))


def drop_incomplete_pairs(df: DataFrame) -> DataFrame:
    """PRJ-3: keep rows whose gold and predicted texts are non-null and non-empty."""
    ok = (F.col("gold").isNotNull() & (F.col("gold") != "")
          & F.col("predicted").isNotNull() & (F.col("predicted") != ""))
    return df.where(ok)


# Spark plans ``row_number() <= n`` as a per-partition group limit before the
# shuffle up to this n (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_MAX = 1000


def cap_samples(df: DataFrame, n: int, by: str = "split", order: str = "doc_id") -> DataFrame:
    """PRJ-4: the first ``n`` rows (by ``order``, a unique key) of every ``by`` group.

    Up to ``GROUP_LIMIT_MAX`` the window is cut to ``n`` rows per split and
    input partition before it is exchanged, so no task sees a whole split.
    Beyond that the position inside the split comes from the distributed
    ordering (:func:`~quillmark.operators.ranking.global_position`).
    """
    if n <= GROUP_LIMIT_MAX:
        w = Window.partitionBy(by).orderBy(order)
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    from quillmark.operators.ranking import global_position
    pos = global_position(df, [F.col(by).asc(), F.col(order).asc()])
    first = pos.groupBy(by).agg(F.min("_start").alias("_g0"))
    return pos.join(first, by).where(F.col("_start") - F.col("_g0") < n).drop("_start", "_g0")


def strip_pair_texts(df: DataFrame, cols=("gold", "predicted")) -> DataFrame:
    """PRJ-5: Python-style ``strip()`` of the text columns."""
    for c in cols:
        df = df.withColumn(c, tx.strip_text(c))
    return df


def split_sentences(df: DataFrame, col: str = "predicted") -> DataFrame:
    """PRJ-6: ``split('. ')`` into ``sentences`` and the rejoined text."""
    parts = tx.split_sentences_naive(col)
    return df.withColumn("sentences", parts).withColumn(
        "rejoined", tx.join_sentences_naive("sentences"))


def sentence_lines(df: DataFrame, cols=("gold", "predicted")) -> DataFrame:
    """PRJ-7: one sentence per line (so ROUGE-Lsum sees sentences)."""
    for c in cols:
        df = df.withColumn(c, tx.sentence_lines(c))
    return df


def scale_round(df: DataFrame, cols: list[str], factor: float = 100.0, places: int = 4) -> DataFrame:
    """PRJ-14: ``round(v * 100, 4)`` on every score column."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) * F.lit(factor), places))
    return df


def add_prefix(df: DataFrame, prefix: str = "", col: str = "gold") -> DataFrame:
    """PRJ-16: source prefix + text (default empty prefix, the active behaviour)."""
    return df.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


def flatten_scores(df: DataFrame, key: str = "pair_id", struct_cols: list[str] | None = None) -> DataFrame:
    """PRJ-13: spread struct score columns into top-level columns.

    Duplicate names are an error, not last-wins.
    """
    struct_cols = struct_cols or [f.name for f in df.schema.fields
                                  if f.dataType.typeName() == "struct"]
    names: list[str] = [c for c in df.columns if c not in struct_cols]
    for s in struct_cols:
        for f in df.schema[s].dataType.fields:
            if f.name in names:
                raise ValueError(f"duplicate score column {f.name!r}")
            names.append(f.name)
    return df.select(*[c for c in df.columns if c not in struct_cols],
                     *[F.col(f"{s}.*") for s in struct_cols])


def align_pairs(gold: DataFrame, predicted: DataFrame, key: str = "pair_id") -> DataFrame:
    """JOI-1: zip gold and predicted streams by key (inner equi-join)."""
    return gold.join(predicted, key, "inner")


def check_alignment(gold: DataFrame, predicted: DataFrame, key: str = "pair_id",
                    strict: bool = False) -> DataFrame:
    """JOI-2: keys present on one side only, with the side that has them.

    ``strict=True`` raises :class:`AlignmentError` if any key is unmatched
    (the reference's end-of-stream error); this runs one ``isEmpty`` job.
    """
    g = gold.select(key).withColumn("_g", F.lit(1))
    p = predicted.select(key).withColumn("_p", F.lit(1))
    j = g.join(p, key, "full_outer").where(F.col("_g").isNull() | F.col("_p").isNull())
    out = j.select(key, F.when(F.col("_g").isNull(), F.lit("predicted"))
                   .otherwise(F.lit("gold")).alias("only_in"))
    if strict and not out.isEmpty():
        raise AlignmentError("gold and predicted streams have different keys")
    return out


def combine_metrics(frames: list[DataFrame], key: str = "pair_id") -> DataFrame:
    """JOI-3: all metric frames side by side on ``key``.

    Every metric frame is already hash-partitioned by ``key`` (see
    :mod:`quillmark.operators.tokens`), so the n-way join needs no new
    exchange when the inputs come from the same pair table.
    """
    out = frames[0]
    for f in frames[1:]:
        dup = (set(out.columns) & set(f.columns)) - {key}
        if dup:
            raise ValueError(f"duplicate score columns {sorted(dup)}")
        out = out.join(f, key, "inner")
    return out


def assemble_transcript(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """JOI-4: one transcript per conversation, ``role: text`` lines in turn order.

    ``collect_list`` is combined map-side (partial aggregation), so each
    task only merges its conversations' already-collected turns.
    """
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    g = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("_t"))
    return g.select(key, F.array_join(F.transform("_t", lambda s: s["line"]), "\n").alias("transcript"))


def join_annotations(scores: DataFrame, annotations: DataFrame, key: str = "pair_id") -> DataFrame:
    """JOI-5: metric scores with human annotations (inner join)."""
    return scores.join(annotations, key, "inner")


def unannotated_pairs(scores: DataFrame, annotations: DataFrame, key: str = "pair_id") -> DataFrame:
    """JOI-5 companion: scored pairs without any annotation (``left_anti``)."""
    return scores.join(annotations.select(key), key, "left_anti")


def union_systems(frames: Mapping[str, DataFrame]) -> DataFrame:
    """SET-1: one frame per system, stacked with a ``system`` column."""
    items = [df.withColumn("system", F.lit(name)) for name, df in frames.items()]
    out = items[0]
    for df in items[1:]:
        out = out.unionByName(df)
    return out


def preview(df: DataFrame, n: int = 20, order: str = "pair_id") -> DataFrame:
    """LIM-1: the first ``n`` rows by ``order`` (planned as a top-k)."""
    return df.orderBy(order).limit(n)
