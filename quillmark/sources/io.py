"""

Readers always take an explicit schema (no inference pass over the data).
Writers are partitioned by a low-cardinality column where the reference
writes one file per value.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.session import ensure_checkpoint_dir

PAIR_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("gold", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("transcript", T.StringType()),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

_CSV = {"header": "true", "escape": '"', "quote": '"', "multiLine": "true"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quillmark-out/{name}-{uuid.uuid4().hex[:10]}"


def read_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA,
               sep: str = ";") -> DataFrame:
    """SRC-1: ``;``-separated pair CSV with header, quoted multi-line text.
    Empty fields read as NULL."""
    return spark.read.schema(schema).options(**_CSV).option("sep", sep).csv(path)


def write_pairs_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Writer matching :func:`read_pairs` (used to produce reference-style inputs)."""
    df.write.mode("overwrite").options(**_CSV).option("sep", sep).csv(path)


def read_splits(spark: SparkSession, files: Mapping[str, tuple[str, str]],
                schema: T.StructType) -> DataFrame:
    """SRC-2: one file per split, format decided **per file**.

    ``files`` maps split name -> ``(path, format)``; format is one of
    ``csv``, ``json``, ``text``, ``parquet``.
    """
    out = None
    for split, (path, fmt) in files.items():
        r = spark.read
        if fmt == "csv":
            df = r.schema(schema).options(**_CSV).csv(path)
        elif fmt == "text":
            df = r.text(path).withColumnRenamed("value", schema.fields[0].name)
        else:
            df = r.schema(schema).format(fmt).load(path)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_scores(df: DataFrame, path: str, partition_by: str | None = None,
                 fmt: str = "csv") -> None:
    """SNK-1: comma CSV with header (or parquet), optionally one folder per value."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.options(**_CSV).csv(path)
    else:
        w.format(fmt).save(path)


def read_scores(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).options(**_CSV).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def write_run_results(df: DataFrame, path: str) -> None:
    """SNK-2: per-row prediction, label and scores, one folder per (run, split)."""
    df.write.mode("overwrite").partitionBy("run_id", "split").options(**_CSV).csv(path)


def write_predictions_text(df: DataFrame, path: str, key: str = "pair_id",
                           col: str = "predicted") -> None:
    """SNK-3: stripped predictions, one per line, newlines flattened.

    Each line is ``key<TAB>text``: part files have no global order, so the
    key travels with the line.
    """
    line = F.concat_ws("\t", F.col(key).cast("string"),
                       F.regexp_replace(tx.strip_text(col), "[\r\n]", " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def read_predictions_text(spark: SparkSession, path: str, key: str = "pair_id",
                          col: str = "predicted") -> DataFrame:
    parts = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path, lineSep="\n").select(parts.getItem(0).cast("long").alias(key),
                                        parts.getItem(1).alias(col))


def append_run_log(df: DataFrame, path: str) -> None:
    """SNK-4: append long rows ``(run_id, split, metric, value)``.

    A run's split is a folder of its own that is published whole and replaces
    what an earlier attempt of the same run left there, so a run that is tried
    again is in the log once; other runs stay.
    """
    df.select([F.col(f.name).cast(f.dataType) for f in RUN_LOG_SCHEMA.fields]) \
      .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "split").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path).select(*RUN_LOG_SCHEMA.names)
