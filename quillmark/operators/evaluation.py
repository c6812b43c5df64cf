"""

One job does what an evaluation callback does: decode predictions and labels,
strip them, put one sentence on a line, score stemmed ROUGE per row (times 100,
4 places) and write the rows; the run's means and ``gen_len`` are gathered by
the same job while it writes (``DataFrame.observe``), so nothing is scored or
read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators.metrics.lcs import rouge_stemmed
from quillmark.operators.pairs import scale_round
from quillmark.operators.tokens import LABEL_IGNORE, PAD_ID, decode_columns, unmask_labels
from quillmark.sources import io

ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")
EVALUATION_SCHEMA = ("pair_id long, prediction string, label string, rouge1 double, rouge2 double, rougeL double, "
                     "rougeLsum double, gen_len long, run_id string, split string")


def decoded_outputs(outputs: DataFrame, vocab: DataFrame, key: str = "pair_id", predictions: str = "predictions",
                    labels: str = "labels") -> DataFrame:
    """``(key, prediction, label, gen_len)``: both texts, stripped and with one
    sentence a line, and the prediction's count of ids that are no padding."""
    ids = unmask_labels(outputs, labels)
    texts = decode_columns(ids, vocab, {"prediction": predictions, "label": labels}, key)
    n = F.size(F.filter(predictions, lambda x: (x != PAD_ID) & (x != LABEL_IGNORE))).cast("long")
    lines = [tx.sentence_lines(tx.strip_text(c)).alias(c) for c in ("prediction", "label")]
    return texts.select(key, *lines).join(outputs.select(key, n.alias("gen_len")), key)


def row_scores(decoded: DataFrame, key: str = "pair_id") -> DataFrame:
    """``decoded`` with the stemmed ROUGE F-scores of ``prediction`` against ``label``."""
    s = rouge_stemmed(decoded.select(key, F.col("label").alias("gold"), F.col("prediction").alias("predicted")), key)
    s = scale_round(s.select(key, *[F.col(f"{r}_f").alias(r) for r in ROUGE]), list(ROUGE))
    return decoded.join(s, key).select(key, "prediction", "label", *ROUGE, "gen_len")


def evaluate_predictions(outputs: DataFrame, vocab: DataFrame, path: str, run_id: str, split: str,
                         key: str = "pair_id") -> DataFrame:
    """Write a row per prediction below ``path`` and return the run's one row of
    means (``rouge1``, ``rouge2``, ``rougeL``, ``rougeLsum``, ``gen_len``, ``rows``).

    ``outputs``: ``key, predictions, labels`` id arrays, padded, labels masked.
    Without rows the means are null.
    """
    rows = row_scores(decoded_outputs(outputs, vocab, key), key)
    seen = Observation(f"{run_id}-{split}")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in (*ROUGE, "gen_len")])
    io.write_run_results(rows.withColumn("run_id", F.lit(run_id)).withColumn("split", F.lit(split)), path)
    found = seen.get
    means = [F.lit(found[c]).cast("double").alias(c) for c in (*ROUGE, "gen_len")]
    return outputs.sparkSession.range(1).select(*[tx.r6(c).alias(n) for c, n in zip(means, (*ROUGE, "gen_len"))],
                                                F.lit(found["rows"]).cast("long").alias("rows"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`evaluate_predictions` wrote."""
    return spark.read.schema(EVALUATION_SCHEMA).options(header="true", escape='"', multiLine="true").csv(path)
