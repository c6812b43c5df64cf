"""Quality classifier: supervised subword embeddings.

Every word, every n-gram of characters or kinds of characters, and every step
back to a word's last occurrence has a learned vector, found by hash. A
document is the average of the vectors of all its features, and a softmax
over that average gives its class. The vectors and the softmax are trained by
stochastic gradient descent in numpy on a bounded, class-balanced sample of
labelled rows; the class prior of all labelled rows is put back afterwards.

Scoring needs one number a feature: the average of vectors times the softmax
weights is the average of (vector times weights). The trained table is 2**BITS
floats, a fixed size, and goes to the tasks with the function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.batches import chunks, tidy
from quillmark.llm.features import fit_in_one_task, fold_of, hash_sample, hashed_features, sparse_sample
from quillmark.llm.tables import documents, fresh, table

#: Buckets of features (2**BITS), n-gram lengths, length of a vector.
BITS, GRAMS, WIDTH = 18, (3, 4), 16
#: Weight of a word's recency (repetition) beside its other features.
AGAIN = 8
#: Length of n-grams of kinds of characters.
SHAPE = 4
#: Labelled documents of either class that train the classifier, at most.
TRAIN_ROWS = 700
EPOCHS, RATE, MIN_STEPS = 8, 0.5, 12_000
#: The fold that is held out: crc32(doc_id) mod 3 is 1.
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5


def fit(rows: list[tuple], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """``(weight of each bucket, bias)`` of the log odds of class 1, from
    ``(class, buckets, counts, words)``; zeros if a class is missing."""
    size = 1 << BITS
    if len({c for c, *_ in rows}) < 2:
        return np.zeros(size, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (size, WIDTH)).astype(np.float32)
    top, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    of_class = [[r for r in rows if r[0] == c] for c in (0, 1)]
    steps, done = max(epochs * len(rows), MIN_STEPS), 0
    while done < steps:
        # One pass over the larger class, the classes taking turns.
        turns = [rng.permutation(max(map(len, of_class))) % len(some) for some in of_class]
        for c, i in [x for pair in zip(*turns, strict=True) for x in enumerate(pair)]:
            _, key, n, _ = of_class[c][i]
            lr, done = rate * max(0.0, 1 - done / steps), done + 1
            share = n / n.sum() if len(n) else n
            mean = share @ vectors[key] if len(key) else np.zeros(WIDTH, np.float32)
            z = mean @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[c] -= 1
            back = top @ p
            top -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            if len(key):
                # Per feature the step is that of an average over a document's features.
                vectors[key] -= (lr * np.minimum(1.0, share * len(key)))[:, None] * back
    return (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows outside the held-out fold, in one task on an executor."""
    known = labels.where((fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for c in (0, 1):
        some = hash_sample(known.where(F.col("quality") == c), TRAIN_ROWS).withColumn("grp", F.lit(c))
        ids = some if ids is None else ids.unionByName(some)
    def fitted(rows: list[tuple]) -> pa.Table:
        weights, bias = fit(rows)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias],
                         "classes": pa.array([len({c for c, *_ in rows})], pa.int64())})

    sample = sparse_sample(docs, ids, BITS, GRAMS, AGAIN, shape=SHAPE)
    found = fit_in_one_task(sample, fitted, "weights binary, bias double, classes long").to_pylist()
    weights, bias, classes = np.zeros(1 << BITS, np.float32), 0.0, 0
    if found:
        weights, bias, classes = np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], found[0]["classes"]
    # The classes took turns: back to the shares of all labelled rows.
    if classes == 2:
        bias += math.log(shares[1] / shares[0])
    elif shares:
        bias += 4.0 if max(shares, key=shares.get) == 1 else -4.0
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with another column (0 to 1): the softmax's share of class 1, from the whole text.

    Null and empty texts have no features and get the score of the bias.
    """
    weights, bias = model
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                total, count = np.zeros(part.n), np.zeros(part.n)
                for doc, bucket, weight in hashed_features(part, BITS, GRAMS, AGAIN, SHAPE):
                    total += weight * np.bincount(doc, weights[bucket], part.n)
                    count += weight * np.bincount(doc, minlength=part.n)
                z = bias + total / np.maximum(count, 1)
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                own = batch.slice(part.row, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p, pa.float64())], names=[*names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(tidy(scored), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels of the held-out fold are never read; ``lang``, ``source``,
    ``doc_id`` and labels are no inputs of a score. Without labels of both
    classes every score is that of the prior. Rows with equal texts get equal
    scores; an empty table gives no rows.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for class 1, with all their columns."""
    column = fresh(docs, "score")
    return score(docs, train(docs, labels), column).where(F.col(column) >= THRESHOLD).drop(column)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
