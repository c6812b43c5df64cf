"""Pair operators, tokens, I/O round trips, quality checks, ranking, joins."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions.stem import porter_stem
from quillmark.operators import analysis as an
from quillmark.operators import pairs as pr
from quillmark.operators import quality as dq
from quillmark.operators import tokens as tk
from quillmark.operators.joins import salted_join, sized_broadcast_join
from quillmark.operators.ranking import global_position
from quillmark.sources import io


def test_drop_incomplete_pairs_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "a", ""), (4, "", None), (5, " ", "x")],
                               "pair_id long, gold string, predicted string")
    assert sorted(r.pair_id for r in pr.drop_incomplete_pairs(df).collect()) == [1, 5]


def test_optional_transcript_absent_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "pair_id long, gold string, predicted string")
    r = pr.optional_transcript(df).first()
    assert r["transcript"] is None and r["has_transcript"] is False


def test_select_pair_columns_missing_column_errors(spark):
    df = spark.createDataFrame([(1, "a")], "pair_id long, gold string")
    with pytest.raises(Exception):
        pr.select_pair_columns(df).collect()


def test_check_alignment_strict_raises(spark):
    g = spark.createDataFrame([(1, "a"), (2, "b")], "pair_id long, gold string")
    h = spark.createDataFrame([(1, "x")], "pair_id long, predicted string")
    rep = pr.check_alignment(g, h).collect()
    assert [(r.pair_id, r.only_in) for r in rep] == [(2, "gold")]
    with pytest.raises(pr.AlignmentError):
        pr.check_alignment(g, h, strict=True)


def test_flatten_scores_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, (0.1,), (0.2,))], "pair_id long, a struct<x: double>, b struct<x: double>")
    with pytest.raises(ValueError):
        pr.flatten_scores(df)


def test_encode_decode_round_trip(spark, pairs):
    vocab = tk.build_vocab(pairs, ["gold", "predicted"])
    ids = [r.id for r in vocab.orderBy("rank").collect()]
    assert ids == list(range(2, 2 + len(ids)))
    enc = tk.encode_truncate_pad(pairs, vocab, max_source=8, max_target=4)
    rows = {r.pair_id: r for r in enc.collect()}
    assert all(len(r.input_ids) == 8 and len(r.labels) == 4 for r in rows.values())
    dec = {r.pair_id: r.decoded for r in tk.decode_ids(enc, vocab).collect()}
    assert dec[1] == "the cat sat on the mat"
    assert dec[5] == ""
    m = tk.mask_labels(enc)
    assert all(x != 0 for r in m.collect() for x in r.labels)
    back = tk.unmask_labels(m).collect()
    assert {r.pair_id: list(r.labels) for r in back} == {k: list(v.labels) for k, v in rows.items()}


def test_attention_masks(spark):
    df = spark.createDataFrame([(1, [5, 6, 0, 0])], "pair_id long, input_ids array<int>")
    r = tk.attention_masks(df).first()
    assert list(r.attention_mask) == [1, 1, 0, 0] and list(r.global_attention_mask) == [1, 0, 0, 0]


def test_read_pairs_round_trip_quotes_newlines(spark, tmp_path):
    rows = [(1, 'say "hi"; ok', "line1\nline2", None), (2, "back\\slash", "x;y", "t")]
    df = spark.createDataFrame(rows, io.PAIR_SCHEMA)
    path = str(tmp_path / "pairs")
    io.write_pairs_csv(df, path)
    back = {r.pair_id: tuple(r) for r in io.read_pairs(spark, path).collect()}
    assert back == {r[0]: r for r in rows}


def test_predictions_text_round_trip(spark, tmp_path, pairs):
    path = str(tmp_path / "preds")
    io.write_predictions_text(pairs, path)
    back = {r.pair_id: r.predicted for r in io.read_predictions_text(spark, path).collect()}
    assert len(back) == 10 and back[1] == "The cat sat on the mat."


def test_require_splits(spark):
    df = spark.createDataFrame([("train",), ("test",)], "split string")
    assert [r.split for r in dq.require_splits(df, ["train", "validation"]).collect()] == ["validation"]
    with pytest.raises(dq.MissingSplitError):
        dq.require_splits(df, ["train", "validation"], strict=True)


def test_repeat_ngram_rate(spark):
    df = spark.createDataFrame([(1, "a b c a b c"), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.repeat_rate for r in dq.repeat_ngram_rate(df, "doc_id", "text").collect()}
    assert got[1] == pytest.approx(1 - 3 / 4) and got[2] is None


def test_global_position_matches_sorted_order(spark):
    rows = [(i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, v long").withColumn("w", F.lit(2))
    pos = global_position(df, [F.col("g"), F.col("v")], weight="w", partitions=5)
    got = {(r.g, r.v): r._start for r in pos.collect()}
    expect = {k: 2 * i for i, k in enumerate(sorted(rows))}
    assert got == expect


def test_average_ranks_and_spearman(spark):
    rows = [("m", "e", float(x), float(y)) for x, y in [(1, 0), (2, 0), (2, 1), (3, 1), (4, 1)]]
    obs = spark.createDataFrame(rows, "metric string, error_type string, value double, present double")
    r = an.correlations(obs, ["metric", "error_type"], "value", "present").first()
    # ranks x: 1, 2.5, 2.5, 4, 5; y: 1.5, 1.5, 4, 4, 4
    import numpy as np
    rx, ry = np.array([1, 2.5, 2.5, 4, 5]), np.array([1.5, 1.5, 4, 4, 4])
    assert r.spearman == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-6)
    assert r.pearson == pytest.approx(np.corrcoef([1, 2, 2, 3, 4], [0, 0, 1, 1, 1])[0, 1], abs=1e-6)


def test_constant_column_gives_null_correlation(spark):
    rows = [("m", "e", 1.0, float(y)) for y in (0, 1, 0)]
    obs = spark.createDataFrame(rows, "metric string, error_type string, value double, present double")
    r = an.correlations(obs, ["metric", "error_type"], "value", "present").first()
    assert r.pearson is None and r.spearman is None


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, k long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    a = sorted(tuple(r) for r in big.join(small, "k", "left").collect())
    b = sorted(tuple(r) for r in salted_join(big, small, ["k"], "left", salt=4).collect())
    c = sorted(tuple(r) for r in sized_broadcast_join(big, small, ["k"], "left", max_rows=1).collect())
    assert a == b == c


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_sends_no_table_through_the_driver(spark, tmp_path):
    """Rows that were too many to broadcast: their compressed files look small to Spark."""
    spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(str(tmp_path / "s"))
    small = spark.read.parquet(str(tmp_path / "s"))
    big = spark.range(6000).select("id", (F.col("id") % 4000).alias("k"))
    got = salted_join(big, small, ["k"], "left", salt_by=["id"])
    assert "Broadcast" not in _plan(got) and "Generate" not in _plan(got) and "SortMergeJoin" in _plan(got)
    want = big.join(small, "k", "left")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_salted_join_copies_the_rows_of_hot_keys_only(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(str(tmp_path / "s"))
    small = spark.read.parquet(str(tmp_path / "s"))
    big = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(
        F.col("id")).alias("k"))
    for how in ("left", "inner"):
        got = salted_join(big, small, ["k"], how, salt=16, salt_by=["id"])
        assert "SortMergeJoin" in _plan(got)
        want = big.join(small, "k", how)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # Keys of two types have no common hash.
    other = small.withColumn("k", F.col("k").cast("int"))
    got = salted_join(big, other, ["k"], "left", salt=4, salt_by=["id"]).select("id", "v")
    assert got.exceptAll(big.join(small, "k", "left").select("id", "v")).isEmpty() and got.count() == 6000


def test_porter_stemmer_examples():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file",
             "happy": "happi", "relational": "relat", "generalization": "gener",
             "hopefulness": "hope", "adjustment": "adjust", "controlling": "control",
             "rate": "rate", "sky": "sky"}
    for w, s in cases.items():
        assert porter_stem(w) == s, w


def test_cap_samples_both_paths(spark):
    rows = [(i, "train" if i % 3 else "test") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, split string")
    for n in (5, 1500):
        got = sorted((r.split, r.doc_id) for r in pr.cap_samples(df, n).collect())
        exp = sorted((s, d) for s in ("train", "test")
                     for d in sorted(d for d, x in rows if x == s)[:n])
        assert got == exp


def test_split_lookup_equals_left_join(spark):
    from quillmark.operators.joins import hot_keys, split_lookup
    rows = spark.createDataFrame([(i, i % 5 if i < 95 else None, "x" if i % 2 else None) for i in range(100)],
                                 "id long, k long, s string")
    table = spark.createDataFrame([(0, "x", 0.5), (1, "x", 1.5), (2, "y", 2.5), (3, "x", None)], "k long, s string, val double")
    for share in (1e-4, 0.15, 1.0):
        for keys in (["k"], ["k", "s"]):
            want = sorted(map(str, rows.join(table.select(*keys, "val"), keys, "left").select("id", *keys, "val").collect()))
            got = split_lookup(rows, table, keys, ["val"], share).select("id", *keys, "val")
            assert sorted(map(str, got.collect())) == want
    assert hot_keys(rows, ["k"], 0.15).count() == 5 and hot_keys(rows.limit(0), ["k"]).count() == 0


def test_split_lookup_spreads_tokens_that_the_table_lacks(spark):
    """A third of the rows have one token; the table doesn't know it."""
    from quillmark.operators.joins import split_lookup
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "user").otherwise(
        F.concat(F.lit("t"), (F.col("id") % 4001).cast("string"))).alias("token"))
    table = spark.range(4001).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), F.col("id").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain = rows.join(table, "token", "left").groupBy(F.spark_partition_id()).count().collect()
        got = split_lookup(rows, table, ["token"], ["n"])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.where("n is null").count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in plain) > 2 * 30_000 / 8
    assert len(sizes) == 8 and sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / 8


def test_checkpoint_dir_is_read_not_replaced(spark):
    from quillmark.session import ensure_checkpoint_dir
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()


def test_score_with_builds_scorer_per_task_not_per_row(spark, pairs):
    import pandas as pd

    from quillmark.operators.registry import score_with

    def make():
        built = {"n": 0}
        built["n"] += 1

        def score(pdf):
            return pd.DataFrame({"pair_id": pdf["pair_id"], "builds": built["n"]})
        return score
    out = score_with(pairs.repartition(2), make, "pair_id long, builds long").collect()
    assert len(out) == 10 and all(r.builds == 1 for r in out)
