"""Driver tables and the fixture views built on them (FIXTURES.md).

Every view is a lazy DataFrame over the parquet scan, so Catalyst prunes
columns and pushes filters into the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.joins import sized_broadcast_join

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the fixture conventions (FIXTURES.md).
PAIR_TURNS = 2 ** 32            # pair_id = conv_id * PAIR_TURNS + turn
LONG_DOC_CHARS = 3000           # challenge "long"
MANY_LINES = 20                 # challenge "many_lines"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn as gold, the next assistant turn as predicted.

    The self-join is an equi-join on ``(conv_id, turn + 1)``: the key is
    unique per turn, so a very long conversation does not skew it.
    """
    c = table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("gold"))
    b = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"),
        F.col("text").alias("predicted"))
    j = a.join(b, (a.conv_id == b.b_conv) & (b.b_turn == a.turn + 1))
    return j.select((F.col("conv_id") * PAIR_TURNS + F.col("turn")).alias("pair_id"),
                    "conv_id", "gold", "predicted")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, transcript)``: turns ordered by ``turn`` as ``role: text`` lines."""
    from quillmark.operators.pairs import assemble_transcript
    return assemble_transcript(table(spark, sf_dir, "conversations"))


def pairs_conv_with_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_conv(spark, sf_dir)
    return p.join(transcripts(spark, sf_dir), "conv_id", "left")


def pairs_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping parts of each whole document: its first and its last two thirds."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("pair_id"), F.col("source").alias("system"),
        F.expr("substr(text, 1, cast((2 * length(text) + 2) div 3 as int))").alias("gold"),
        F.expr("substr(text, cast(length(text) div 3 + 1 as int))").alias("predicted"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    l = table(spark, sf_dir, "labels")
    return d.join(l, "doc_id")


def pairs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against benchmark passages.

    A document's passage is item ``doc_id`` modulo the number of passages (a
    scalar subquery). The passages are broadcast after a size check; past the
    bound the join is salted, as few keys would put all documents in few tasks.
    """
    d = labelled_documents(spark, sf_dir).select("doc_id", "source", "lang", "text", "n_chars")
    passages = table(spark, sf_dir, "benchmark")
    b = passages.select(F.col("item_id").alias("bench_key"), F.col("text").alias("gold"))
    d = d.withColumn("bench_key", F.col("doc_id") % passages.agg(F.count(F.lit(1))).scalar())
    j = sized_broadcast_join(d, b, ["bench_key"], "inner")
    return j.select(
        F.col("doc_id").alias("pair_id"), F.col("source").alias("system"), "lang", "gold",
        F.col("text").alias("predicted"), "n_chars",
        F.when(F.substring("source", 4, 1_000_000).cast("int") % 2 == 0, F.lit("A"))
         .otherwise(F.lit("B")).alias("arch"))


def ann_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations in long form: ``(pair_id, error_type, present, severity)``."""
    l = table(spark, sf_dir, "labels")
    sev = (1 - F.col("quality")) + F.col("toxic")
    return l.select(F.col("doc_id").alias("pair_id"), F.inline(F.array(
        F.struct(F.lit("low_quality").alias("error_type"), (1 - F.col("quality")).alias("present"),
                 sev.alias("severity")),
        F.struct(F.lit("toxic").alias("error_type"), F.col("toxic").alias("present"),
                 sev.alias("severity")))))


def chal_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenges in long form: ``(pair_id, challenge, present)``."""
    from quillmark.functions.text import line_count
    d = labelled_documents(spark, sf_dir)

    def flag(c):
        return F.when(c, F.lit(1)).otherwise(F.lit(0))
    return d.select(F.col("doc_id").alias("pair_id"), F.inline(F.array(
        F.struct(F.lit("long").alias("challenge"),
                 flag(F.col("n_chars") >= LONG_DOC_CHARS).alias("present")),
        F.struct(F.lit("non_english").alias("challenge"),
                 flag(F.col("lang") != "en").alias("present")),
        F.struct(F.lit("many_lines").alias("challenge"),
                 flag(line_count(F.col("text")) >= MANY_LINES).alias("present")))))


def documents_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a ``split`` column (doc_id % 10: 0-7 train, 8 validation, 9 test)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 10
    return d.withColumn("split", F.when(k <= 7, F.lit("train"))
                        .when(k == 8, F.lit("validation")).otherwise(F.lit("test")))
