"""The corpus pipeline: documents through five operators of ``quillmark.llm``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; it is written as Parquet
and read again as the next one's input, and works on all that its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.bpe import encoded
from quillmark.llm.minhash import first_documents
from quillmark.llm.mixing import mixed_documents
from quillmark.llm.quality import good_documents
from quillmark.llm.secrets import redacted_documents
from quillmark.llm.tables import documents, staged, table

#: The least similarity of word shingles, in percent, at which documents are near-duplicates.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity ``NEAR_PERCENT``) stays."""
    return first_documents(docs, NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by the name of their kind."""
    return redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every row."""
    return encoded(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("packed").alias("ids"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A trained classifier has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    df = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        df = staged(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
