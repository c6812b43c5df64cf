"""Stemmed ROUGE, counting kernels, all metrics side by side and the evaluation of a run."""

from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.functions import counting
from quillmark.functions.stem import stem_token
from quillmark.operators import evaluation as ev
from quillmark.operators import tokens as tk
from quillmark.operators.metrics import chrf, combined, lcs, lm, meteor, overlap, vectors
from quillmark.sources import io


def by_key(df, key="pair_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def random_lists(rng, rows):
    return [[str(x) for x in rng.integers(0, 4, rng.integers(0, 14))] for _ in range(rows)]


@pytest.mark.parametrize("seed", range(20))
def test_counting_kernels(seed, monkeypatch):
    monkeypatch.setattr(counting, "CHUNK_ITEMS", 50)
    rng = np.random.default_rng(seed)
    rows = int(rng.integers(1, 9))
    left, right = random_lists(rng, rows), random_lists(rng, rows)
    kind = pa.list_(pa.string())
    a, b = counting.list_codes(pa.array(left, kind), pa.array(right, kind))
    got = counting.clipped_matches(a, b, 5)
    matches, chunks = counting.aligned(a, b)
    for r, (x, y) in enumerate(zip(left, right, strict=True)):
        for n in range(1, 6):
            assert got[r, n - 1] == sum((brute.grams(x, n) & brute.grams(y, n)).values())
        m, want = int(matches[r]), brute.meteor(" ".join(x), " ".join(y))
        if m:
            p, q = m / len(y), m / len(x)
            assert abs(want - p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (int(chunks[r]) / m) ** 3)) < 1e-12
        else:
            assert want == 0
    sliced = pa.array([None, ["a"], *left], kind).slice(2)
    assert [c.tolist() for c in counting.list_codes(sliced)[0]][1][-1] == sum(map(len, left))


def test_lcs_positions_follow_the_textbook_walk():
    rng = np.random.default_rng(0)
    for _ in range(300):
        ref, can = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 9))] for _ in range(2))
        t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
        for i, x in enumerate(ref, 1):
            for j, y in enumerate(can, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        i, j, want = len(ref), len(can), []
        while i and j:
            if ref[i - 1] == can[j - 1]:
                want.append(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert lcs.lcs_positions(ref, can) == want[::-1]


def test_rouge_stemmed_all_scores(spark, pairs):
    got = by_key(lcs.rouge_stemmed(pairs))
    for r in pairs.collect():
        g, h = ([stem_token(t) for t in brute.tok(x)] for x in (r.gold, r.predicted))
        for n in (1, 2):
            p, q, f = brute.rouge_n(" ".join(g), " ".join(h), n)
            assert (got[r.pair_id][f"rouge{n}_p"], got[r.pair_id][f"rouge{n}_r"], got[r.pair_id][f"rouge{n}_f"]) == (
                round(p, 6), round(q, 6), round(f, 6))
        p, q, f = brute.rouge_l(" ".join(g), " ".join(h))
        assert (got[r.pair_id]["rougeL_p"], got[r.pair_id]["rougeL_r"], got[r.pair_id]["rougeL_f"]) == (
            round(p, 6), round(q, 6), round(f, 6))
    # The same stems from a table, as a user's dictionary would give them.
    words = pairs.select(F.explode(F.array_distinct(F.concat(*[lcs.tx.tok(c) for c in ("gold", "predicted")]))).alias("token"))
    assert by_key(lcs.rouge_stemmed(pairs, stems=lcs.stem_table(words.distinct().where(F.length("token") >= 4)))) == got
    own = spark.createDataFrame([("ran", "run"), ("running", "run"), ("runs", "run"), ("runners", "runner"),
                                 ("quickly", "quick")], "token string, stem string")
    assert by_key(lcs.rouge_stemmed(pairs, stems=own))[9]["rouge1_f"] > got[9]["rouge1_f"]


def test_rouge_stemmed_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, "", ""), (3, "a. b", "a b")], "pair_id long, gold string, predicted string")
    got = by_key(lcs.rouge_stemmed(df))
    assert [got[k]["rougeLsum_f"] for k in (1, 2, 3)] == [0.0, 0.0, 1.0]


def test_all_metrics_equal_the_single_ones(spark, pairs):
    p = pairs.withColumn("system", F.when(F.col("pair_id") % 4 != 0, F.concat(F.lit("s"), (F.col("pair_id") % 3).cast("string"))))
    train = pairs.select("gold")
    vocab = tk.build_vocab(pairs, ["gold", "predicted"])
    vec = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(7)], "vec_id long, embedding array<double>")
    ids = vectors.token_vec_ids(vocab, 7)
    got = combined.all_metrics(p, train=train.withColumnRenamed("gold", "text"), vec_ids=ids, embeddings=vec)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One exchange carries texts: the one to the keys.
    assert plan.count("REPARTITION_BY_COL") == 1
    rows = by_key(got)
    singles = [overlap.rouge_n(pairs), overlap.bleu(pairs), meteor.meteor(pairs), chrf.chrf(pairs), lcs.rouge_l(pairs),
               vectors.embedding_match(pairs, ids, vec),
               lm.lm_perplexity(train, pairs.select("pair_id", "predicted"), "pair_id", "predicted", "gold")]
    for one in singles:
        for k, r in by_key(one).items():
            assert {c: rows[k][c] for c in r} == r
    assert {k: r["gold"] for k, r in rows.items()} == {r.pair_id: r.gold for r in pairs.collect()}
    bare = by_key(combined.all_metrics(p))
    assert all(r["perplexity"] is None and r["em_f"] is None and r["bleu"] == rows[k]["bleu"] for k, r in bare.items())


def test_all_metrics_of_null_texts(spark):
    df = spark.createDataFrame([("a", 1, None, "x y"), ("b", 1, "x", None), (None, 1, "x y", "x y")],
                               "system string, pair_id long, gold string, predicted string")
    got = {r["system"]: r for r in combined.all_metrics(df).collect()}
    assert got["a"]["rouge1_f"] == got["b"]["chrf"] == 0.0 and got[None]["rougeL_f"] == 1.0 and got["a"]["gold"] is None


def test_evaluation_of_a_run(spark, pairs):
    vocab = tk.build_vocab(pairs, ["gold", "predicted"])
    e = tk.encode_columns(pairs, "pair_id", vocab, {"predictions": ("predicted", None), "labels": ("gold", None)})
    e = tk.mask_labels(e.select("pair_id", *[tk.pad_to_multiple(F.col(c), 8).alias(c) for c in ("predictions", "labels")]))
    assert all(len(r.predictions) % 8 == 0 and len(r.labels) % 8 == 0 for r in e.collect())
    path = io.scratch_path(spark, "evaluation-test")
    means = ev.evaluate_predictions(e, vocab, path, "r", "eval").first()
    rows = by_key(ev.read_evaluation(spark, path))
    n = len(rows)
    assert n == means["rows"] == 10 and rows[1]["split"] == "eval"
    for c in (*ev.ROUGE, "gen_len"):
        assert abs(means[c] - sum(r[c] for r in rows.values()) / n) < 1e-6
    stemmed = by_key(lcs.rouge_stemmed(pairs))
    for k, r in rows.items():
        assert r["rouge1"] == round(100 * stemmed[k]["rouge1_f"], 4) and r["gen_len"] == len(brute.tok(
            next(p.predicted for p in pairs.collect() if p.pair_id == k)))
    none = ev.evaluate_predictions(e.limit(0), vocab, io.scratch_path(spark, "evaluation-test"), "r", "eval").first()
    assert none["rows"] == 0 and none["rouge1"] is None


def test_mean_perplexity(spark):
    s = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", None)], "system string, perplexity double")
    assert {r["system"]: (r["mean_perplexity"], r["texts"]) for r in lm.mean_perplexity(s, "system").collect()} == {
        "a": (3.0, 2), "b": (None, 0)}
    assert lm.mean_perplexity(s).first()["mean_perplexity"] == 3.0


def test_encoding_cuts_before_the_lookup(spark, pairs):
    vocab = tk.build_vocab(pairs, ["gold", "predicted"])
    whole = by_key(tk.encode(pairs, "pair_id", "gold", vocab))
    cut = by_key(tk.encode_truncate_pad(pairs, vocab, max_source=3, max_target=2))
    assert all(cut[k]["input_ids"] == (r["ids"] + [0, 0, 0])[:3] for k, r in whole.items())
    assert Counter(len(r["labels"]) for r in cut.values()) == {2: 10}


def test_map_batches_are_exact(spark):
    from quillmark.operators import registry as rg

    def make():
        def fn(pdf):
            return pdf.assign(n=len(pdf), first=pdf["id"].min())
        return fn
    df = spark.range(1000).withColumn("_batch", F.lit("own")).repartition(7, "id")
    got = rg.map_batches(df.select("id"), make, 64, "id long, n long, first long", order=["id"]).collect()
    assert {(r["id"], r["n"], r["first"]) for r in got} == {(i, 64 if i < 960 else 40, i // 64 * 64) for i in range(1000)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10", "100000"):    # the session's batches don't matter
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = rg.map_batches(spark.range(0, 1000, 1, 3), make, 50, "id long, n long, first long").collect()
            sizes = Counter(r["n"] for r in got)
            assert len(got) == 1000 and sizes == {50: 900, 33: 66, 34: 34}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert rg.map_batches(spark.range(0), make, 5, "id long, n long, first long").collect() == []
    with pytest.raises(ValueError):
        rg.map_batches(spark.range(3), make, 0, "id long")


def test_registry_knows_the_metrics_with_tables(spark, pairs):
    from quillmark.operators import registry as rg
    docs = pairs.select(F.col("pair_id").alias("doc_id"), F.col("gold").alias("text"))
    assert "blanc_help" in rg.load("cloze", corpus=docs)(pairs).columns
    assert "fscore" in rg.load("coverage", corpus=docs)(pairs).columns
    scored = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(9)], "pair_id long, a double, y double")
    assert rg.load("learned", features=["a"], label="y")(scored).count() == 9
    with pytest.raises(KeyError):
        rg.load("nothing")


def test_previous_row_is_carried_over_ranges(spark):
    from quillmark.operators.analysis import previous_in_order, turn_challenges
    rng = np.random.default_rng(2)
    rows = [(0, 3 * t, "user" if rng.random() < 0.5 else "bot", "a b") for t in range(300)]     # one long conversation
    rows += [(int(c), t, "user" if t % 2 else None, None) for c in range(1, 40) for t in range(c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = previous_in_order(df, "conv_id", "turn", "role", "prev").collect()
    before = {}
    for c, t, role, _ in sorted(rows, key=lambda r: r[:2]):
        before.setdefault(c, []).append((t, role))
    want = {(c, t): (x[i - 1][1] if i else None) for c, x in before.items() for i, (t, _) in enumerate(x)}
    assert {(r["conv_id"], r["turn"]): r["prev"] for r in got} == want and len(got) == len(rows)
    ranges = df.repartitionByRange(8, "conv_id", "turn").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 150     # 300 turns in many tasks
    one = {r["conv_id"]: r for r in turn_challenges(df).collect()}[0]
    roles = [r[2] for r in rows[:300]]
    assert one["switches"] == sum(a != b for a, b in zip(roles, roles[1:])) and one["turns"] == 300


def test_run_log_of_a_retried_run(spark):
    path = io.scratch_path(spark, "log-test")

    def rows(run, value):
        return spark.createDataFrame([(run, s, "m", value) for s in ("eval", "test")], io.RUN_LOG_SCHEMA)
    io.append_run_log(rows("a", 1.0), path)
    io.append_run_log(rows("b", 2.0), path)
    io.append_run_log(rows("a", 3.0).where("split = 'eval'"), path)
    assert sorted(tuple(r) for r in io.read_run_log(spark, path).collect()) == [
        ("a", "eval", "m", 3.0), ("a", "test", "m", 1.0), ("b", "eval", "m", 2.0), ("b", "test", "m", 2.0)]
