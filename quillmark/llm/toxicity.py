"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier over hashed words and character n-grams is trained in
numpy from confirmed toxic documents and unlabelled text only. Unlabelled
text holds toxic documents too, so its loss as "clean" is corrected by the
class prior: with P the confirmed and U the unlabelled documents, the risk is

    prior * E_P[loss(g, 1)] + max(0, E_U[loss(g, 0)] - prior * E_P[loss(g, 0)])

where the bracket estimates the risk of the clean documents. A flexible model
can drive that estimate below zero, which is overfitting; the step then goes
the other way on the bracket (Kiryo and others, 2017).

Both sets are bounded samples (documented parameters). Only features that tell
P from U clearly are kept, each as presence and as density, so a long clean
text doesn't gather noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.batches import chunks
from quillmark.llm.features import fold_of, hash_sample, hashed_features, lowered, sparse_rows, sparse_sample
from quillmark.llm.tables import documents, table

#: Buckets of features (2**BITS) and n-gram lengths, over lower-cased text.
BITS, GRAMS = 20, (4, 6)
#: Confirmed toxic and unlabelled documents that train the classifier, at most.
TOXIC_ROWS, UNLABELLED_ROWS = 1500, 3000
#: Features kept at most, the least z score and the least number of toxic documents of one.
FEATURES, MIN_Z, MIN_TOXIC = 2048, 4.0, 5
#: Steps, first learning rate, weight decay and first bias of the fit.
STEPS, RATE, DECAY, BIAS = 400, 0.05, 1e-5, -2.0
#: The fold that is held out: crc32(doc_id) mod 4 is 2.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def _density(counts: np.ndarray, n_words) -> np.ndarray:
    """How thickly a feature is strewn: log(1 + occurrences in 100 words)."""
    return np.log1p(100 * counts / np.maximum(n_words, 1))


def select_features(toxic: list[tuple], rest: list[tuple]) -> np.ndarray:
    """Buckets that toxic documents have more often, or more thickly, by the most standard errors."""
    size = 1 << BITS
    n, m = max(1, len(toxic)), max(1, len(rest))
    has, thick, square = np.zeros((2, size)), np.zeros((2, size)), np.zeros((2, size))
    for g, rows in enumerate((toxic, rest)):
        for key, counts, words in rows:
            x = _density(counts, words)
            has[g, key] += 1
            thick[g, key] += x
            square[g, key] += x * x
    both = (has.sum(0) + 1) / (n + m + 2)
    z = (has[0] / n - has[1] / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))
    mean = thick / np.array([[n], [m]])
    spread = square.sum(0) / (n + m) - (thick.sum(0) / (n + m)) ** 2 + 0.01 / (n + m)
    t = (mean[0] - mean[1]) / np.sqrt(spread * (1 / n + 1 / m))
    best = np.maximum(z, t)
    ok = np.flatnonzero((best >= MIN_Z) & (has[0] >= MIN_TOXIC))
    return np.sort(ok[np.argsort(-best[ok], kind="stable")[:FEATURES]])


def _matrix(rows: list[tuple], kept: np.ndarray) -> np.ndarray:
    """Presence and density of every kept feature, side by side."""
    k = len(kept)
    out = np.zeros((len(rows), 2 * k), np.float32)
    for i, (key, counts, words) in enumerate(rows):
        at = np.minimum(np.searchsorted(kept, key), k - 1)
        hit = kept[at] == key
        out[i, at[hit]] = 1
        out[i, k + at[hit]] = _density(counts[hit], words)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(toxic: np.ndarray, rest: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (sigmoid loss, Adam).

    The sigmoid loss is bounded and symmetric, loss(g, 1) = s(-g) and
    loss(g, 0) = s(g): the logistic loss of confirmed documents as "clean"
    has no bound, and its correction would swamp the bracket.
    """
    w, b = np.zeros(toxic.shape[1]), BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        sp, su = _sigmoid(toxic @ w + b), _sigmoid(rest @ w + b)
        clean = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        if clean >= 0:
            gp, gu = -2 * prior * dp, du
        else:   # the clean risk can't be negative: undo, and leave the first term alone
            gp, gu = prior * dp, -du
        grad = np.append(toxic.T @ gp + rest.T @ gu + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        rate = RATE * (1 - t / STEPS) + 1e-4
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias), from rows outside the held-out fold only.

    The class prior is the toxic share of the labelled rows; beyond that the
    labels name the confirmed toxic documents and nothing else.
    """
    fold = fold_of(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.where(fold & F.col("toxic").isin(0, 1))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, max(1e-3, n_toxic / n)) if n else 1e-3
    toxic = known.where(F.col("toxic") == 1)
    # The unlabelled sample is of all text (confirmed documents may be drawn too): its toxic share is the prior.
    ids = hash_sample(toxic, TOXIC_ROWS).withColumn("grp", F.lit(1)).unionByName(
        hash_sample(docs.where(fold), UNLABELLED_ROWS, seed=1).withColumn("grp", F.lit(0)))
    rows = sparse_rows(sparse_sample(docs, ids, BITS, GRAMS, lower=True).toArrow())
    p, u = ([(key, counts, words) for g, key, counts, words in rows if g == x] for x in (1, 0))
    kept = select_features(p, u)
    if not len(kept):
        return kept, np.zeros(0, np.float32), BIAS
    w, b = fit(_matrix(p, kept), _matrix(u, kept), prior)
    return kept, w.astype(np.float32), b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``: the odds of a document by the kept features that its whole text has."""
    kept, weights, bias = model
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int16)
        slot[kept] = np.arange(len(kept))
        for batch in batches:
            for part in chunks(batch):
                hits, words = [np.zeros(0, np.int64)], np.zeros(part.n)
                for k, (doc, bucket, _) in enumerate(hashed_features(lowered(part), BITS, GRAMS)):
                    if not k:   # the words come first
                        words = np.bincount(doc, minlength=part.n)
                    at = slot[bucket]
                    has = np.flatnonzero(at >= 0)
                    hits.append(doc[has] * FEATURES + at[has])
                hits, counts = np.unique(np.concatenate(hits), return_counts=True)
                doc, at = hits // FEATURES, hits % FEATURES
                add = weights[at] + weights[len(kept) + at] * _density(counts, words[doc]) if len(hits) else None
                z = bias + np.bincount(doc, add, part.n)
                own = batch.slice(part.row, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(_sigmoid(z), pa.float64())],
                                                 names=[*names, "score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no features and get the bias's score. Without
    confirmed toxic documents every score is that of the bias. Equal texts
    get equal scores; an empty table gives no rows; labels, ``lang``,
    ``source`` and ``doc_id`` are no inputs of a score.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
