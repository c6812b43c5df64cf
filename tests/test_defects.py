"""Cases that the fixture tables lack: each once gave a wrong result."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import registry
from quillmark.operators.analysis import turn_challenges
from quillmark.operators.metrics.meteor import meteor
from quillmark.sources import io


def test_meteor_token_in_two_synsets_counts_once(spark):
    pairs = spark.createDataFrame([(1, "big", "large")], "pair_id long, gold string, predicted string")
    one = spark.createDataFrame([("big", 1), ("large", 1)], "token string, synset int")
    two = spark.createDataFrame([("big", 1), ("large", 1), ("big", 2), ("large", 2)], "token string, synset int")
    assert meteor(pairs, synonyms=one).first()["meteor"] == meteor(pairs, synonyms=two).first()["meteor"] <= 1


def test_turn_gaps(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "assistant", "b"), (1, 4, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    assert turn_challenges(turns).first()["switches"] == 2


def test_carriage_return_in_predictions(spark):
    df = spark.createDataFrame([(1, "one\rtwo\r\nthree"), (2, "x")], "pair_id long, predicted string")
    path = io.scratch_path(spark, "cr")
    io.write_predictions_text(df, path)
    assert {tuple(r) for r in io.read_predictions_text(spark, path).collect()} == {(1, "one two  three"), (2, "x")}


def test_unicode_strip(spark):
    cases = [" x　", "  y \x1f", "z\n", " ​ ", "\x85q"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", tx.strip_text(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c.strip() for c in cases]


def test_registry_knows_metrics_with_tables(spark, pairs):
    train = pairs.select(F.col("gold").alias("text"), F.col("pair_id").alias("doc_id"))
    assert registry.load("perplexity", train=train)(pairs).count() == pairs.count()
    vec_ids = spark.createDataFrame([("the", 0), ("cat", 1)], "token string, vec_id long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert registry.load("bertscore", vec_ids=vec_ids, embeddings=vectors)(pairs).count() == pairs.count()
    with pytest.raises(KeyError):
        registry.load("nothing")
