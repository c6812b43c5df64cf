"""Input tables and staged intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of ``sf_dir``, read by Spark (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read
    back: a column-pruned lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named_rows(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` staged with a unique number per row and a hash of the row's
    columns (the same wherever the row stands), and the names of those two."""
    row, content = fresh(df, "row_name"), fresh(df, "row_content")
    out = df.withColumn(content, F.xxhash64(*df.columns)).withColumn(row, F.monotonically_increasing_id())
    return staged(out, "named-rows"), row, content


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
