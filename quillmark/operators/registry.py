"""

``METRICS`` plays the role of loading a metric by name: every entry is a
``(pairs DataFrame) -> scores DataFrame`` function keyed by ``pair_id``.
:func:`score_with` is the seam for a user's own model: the model is built
once per task (not per row, not on the driver) and fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.metrics import chrf, cloze, coverage, lcs, learned, lm, meteor, overlap, vectors
from quillmark.operators.ranking import global_position

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rouge": overlap.rouge_n,
    "rouge_l": lcs.rouge_l,
    "rouge_lsum": lcs.rouge_lsum,
    "rouge_stemmed": lcs.rouge_stemmed,
    "bleu": overlap.bleu,
    "meteor": meteor.meteor,
    "chrf": chrf.chrf,
}


# Metrics that need tables beside the pairs: name -> function of those tables.
FACTORIES: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "perplexity": lambda train: lambda pairs: lm.lm_perplexity(
        train, pairs.select("pair_id", "predicted"), key="pair_id", text="predicted"),
    "bertscore": lambda vec_ids, embeddings: lambda pairs: vectors.embedding_match(pairs, vec_ids, embeddings),
    "cloze": lambda corpus: lambda pairs: cloze.cloze_gain(pairs, corpus),
    "coverage": lambda corpus, transcripts=None: lambda pairs: coverage.answer_coverage(pairs, corpus, transcripts),
    # Of scored pairs: the metric columns to weigh and the column of ratings to learn from.
    "learned": lambda features, label: lambda scores: learned.learned_score(scores, features, label),
    "mover_score": lambda vec_ids, embeddings: lambda pairs: vectors.mover_score(pairs, vec_ids, embeddings),
}


def load(name: str, **tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The metric function registered under ``name``, from its tables if it needs any."""
    if name in METRICS:
        return METRICS[name]
    if name in FACTORIES:
        return FACTORIES[name](**tables)
    raise KeyError(f"unknown metric {name!r}; known: {sorted([*METRICS, *FACTORIES])}")


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


BatchFn = Callable[[pd.DataFrame], pd.DataFrame]


def map_batches(df: DataFrame, make_fn: Callable[[], BatchFn], batch_size: int, schema: T.StructType | str,
                order: list[str] | None = None) -> DataFrame:
    """Batched row map: ``make_fn()``, called once a task, maps pandas batches of
    exactly ``batch_size`` rows (fewer in the last), whatever the session's Arrow settings.

    Without ``order`` each task cuts the rows it has, in the order it has them.
    With ``order`` (columns that order the rows strictly) batches are runs of
    all rows in that order: the same batches however the rows are partitioned,
    dealt to tasks by their number. A task holds one batch and one Arrow batch.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    cols = df.columns
    if order:
        df = global_position(df, [F.col(c) for c in order]).withColumn("_batch", F.floor(F.col("_start") / batch_size))
        df = df.repartition("_batch").sortWithinPartitions("_batch", "_start").drop("_start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()

        def full(held: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            # Whole runs of one batch number, or of ``batch_size`` rows.
            number = held["_batch"].to_numpy() if order else np.arange(len(held)) // batch_size
            ends = np.flatnonzero(np.append(number[1:] != number[:-1], True)) + 1
            if not last and (order or len(held) % batch_size):
                ends = ends[:-1]
            for a, b in zip(np.append(0, ends)[:len(ends)], ends, strict=True):
                yield held.iloc[a:b]

        held = None
        for pdf in batches:
            held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
            done = 0
            for part in full(held, False):
                done += len(part)
                yield fn(part[cols].reset_index(drop=True))
            held = held.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            for part in full(held, True):
                yield fn(part[cols].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def score_with(df: DataFrame, make_scorer: Callable[[], Scorer], schema: T.StructType,
               cols: tuple[str, ...] = ("pair_id", "gold", "predicted"), batch_size: int | None = None) -> DataFrame:
    """SCORE-1: run a batch scorer over the pairs with ``mapInPandas``.

    ``make_scorer()`` is called once per task (model loading cost paid once
    per partition); the scorer receives pandas batches of ``cols`` and returns a
    pandas frame matching ``schema``. Batches have ``batch_size`` rows, or by
    default as many as ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if batch_size:
        return map_batches(df.select(*cols), make_scorer, batch_size, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            yield scorer(pdf)
    return df.select(*cols).mapInPandas(run, schema)


LENGTH_RATIO_SCHEMA = T.StructType([T.StructField("pair_id", T.LongType()),
                                    T.StructField("length_ratio", T.DoubleType())])


def make_length_ratio_scorer() -> Scorer:
    """Deterministic stand-in model: predicted / gold character length."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["gold"].str.len().astype("float64")
        h = pdf["predicted"].str.len().astype("float64")
        ratio = (h / g.where(g > 0)).round(6)
        return pd.DataFrame({"pair_id": pdf["pair_id"].astype("int64"), "length_ratio": ratio})
    return score
