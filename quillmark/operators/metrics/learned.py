"""

Re-aimed: the reference applies a trained neural regressor. Here a linear
regression (``pyspark.ml``, normal-equation solver: one distributed
aggregation of XᵀX) maps chosen metric columns to a human rating; the
prediction is z-scored over the run and reported as ``50 + 10 z`` clipped
to 0-100. Same purpose and output shape, not the same values.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.session import cut_lineage

CENTER = 50.0
SCALE = 10.0


def rescale(df: DataFrame, col: str, out: str) -> DataFrame:
    """``50 + 10 z`` clipped to [0, 100]; the run's mean and std-dev are one
    aggregate row used as literals."""
    row = df.agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd")).first()
    z = (F.col(col) - F.lit(row["mu"])) / F.lit(row["sd"]) if row["sd"] else F.lit(0.0)
    return df.withColumn(out, tx.r6(F.least(F.greatest(CENTER + SCALE * z, F.lit(0.0)), F.lit(100.0))))


def learned_score(df: DataFrame, features: list[str], label: str, key: str = "pair_id",
                  out: str = "learned_score") -> DataFrame:
    """``(key, out)`` for every input row; NULL where a feature or the label
    is NULL (those rows are left out of the fit and of the run statistics)."""
    # Read by the fit, the prediction and the run statistics: written once
    # to the shared checkpoint folder instead of recomputing the metrics.
    clean = cut_lineage(df.select(key, *features, F.col(label).cast("double").alias("_y")).dropna())
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(clean)
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal",
                             regParam=0.0, standardization=False).fit(data)
    pred = model.transform(data).select(key, F.col("prediction").alias("_p"))
    scored = rescale(pred, "_p", out).select(key, out)
    return df.select(key).join(scored, key, "left")
