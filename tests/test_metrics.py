"""Metric jobs against brute-force Python on hand-made pairs, plus properties."""

import pytest

from brute import bleu, chrf, meteor, rouge_l, rouge_n
from conftest import PAIRS
from quillmark.operators.metrics import chrf as chrf_m
from quillmark.operators.metrics import lcs, overlap
from quillmark.operators.metrics import meteor as meteor_m

APPROX = dict(abs=1e-6)


def by_key(df):
    return {r["pair_id"]: r for r in df.collect()}


def test_rouge_n_matches_brute_force(pairs):
    got = by_key(overlap.rouge_n(pairs))
    assert len(got) == len(PAIRS)
    for k, g, h in PAIRS:
        for n in (1, 2):
            p, r, f = rouge_n(g, h, n)
            assert got[k][f"rouge{n}_p"] == pytest.approx(p, **APPROX)
            assert got[k][f"rouge{n}_r"] == pytest.approx(r, **APPROX)
            assert got[k][f"rouge{n}_f"] == pytest.approx(f, **APPROX)


def test_rouge_l_matches_brute_force(pairs):
    got = by_key(lcs.rouge_l(pairs))
    for k, g, h in PAIRS:
        p, r, f = rouge_l(g, h)
        assert got[k]["rougeL_f"] == pytest.approx(f, **APPROX)
        assert got[k]["rougeL_p"] == pytest.approx(p, **APPROX)


def test_rouge_l_not_above_rouge_1(pairs):
    r1 = by_key(overlap.rouge_n(pairs, ns=(1,)))
    rl = by_key(lcs.rouge_l(pairs))
    for k, _, _ in PAIRS:
        assert rl[k]["rougeL_f"] <= r1[k]["rouge1_f"] + 1e-9


def test_lcs_bit_parallel_equals_dp():
    import random

    from brute import lcs as lcs_dp
    rnd = random.Random(7)
    for _ in range(200):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        assert lcs.lcs_length(a, b) == lcs_dp(a, b)
        pos = lcs.lcs_positions(a, b)
        assert len(pos) == lcs_dp(a, b) and pos == sorted(pos)


def test_rouge_lsum_single_sentence_equals_rouge_l(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a c e b d")], "pair_id long, gold string, predicted string")
    s = lcs.rouge_lsum(df).first()
    assert s["rougeLsum_f"] == pytest.approx(rouge_l("a b c d e", "a c e b d")[2], **APPROX)


def test_rouge_lsum_union_counts_budget():
    # gold sentence "a b c"; predicted sentences "a b" and "b c": union covers a, b, c
    hits, n_g, n_h = lcs.summary_lcs_hits([["a", "b", "c"]], [["a", "b"], ["b", "c"]])
    assert (hits, n_g, n_h) == (3, 3, 4)
    # budget: the predicted text has one "a" only
    hits, _, _ = lcs.summary_lcs_hits([["a", "x"], ["a", "y"]], [["a"]])
    assert hits == 1


def test_bleu_matches_brute_force(pairs):
    got = by_key(overlap.bleu(pairs))
    for k, g, h in PAIRS:
        assert got[k]["bleu"] == pytest.approx(bleu(g, h), **APPROX)


def test_bleu_identical_long_text_is_one(spark):
    t = "the quick brown fox jumps over the lazy dog again"
    df = spark.createDataFrame([(1, t, t)], "pair_id long, gold string, predicted string")
    assert overlap.bleu(df).first()["bleu"] == pytest.approx(1.0)


def test_bleu_corpus_sums_before_ratio(spark):
    df = spark.createDataFrame([(1, "s", "a b c d e", "a b c d e"), (2, "s", "x y z w v", "q r s t u")],
                               "pair_id long, system string, gold string, predicted string")
    c = overlap.bleu_corpus(df, by="system").first()
    assert c["p1"] == pytest.approx(0.5) and c["translation_length"] == 10


def test_chrf_matches_brute_force(pairs):
    got = by_key(chrf_m.chrf(pairs))
    for k, g, h in PAIRS:
        assert got[k]["chrf"] == pytest.approx(chrf(g, h), **APPROX)


def test_meteor_matches_brute_force(pairs):
    got = by_key(meteor_m.meteor(pairs))
    for k, g, h in PAIRS:
        assert got[k]["meteor"] == pytest.approx(meteor(g, h), **APPROX)


def test_meteor_stem_stage_only_adds_matches(pairs):
    exact = by_key(meteor_m.meteor(pairs))
    stem = by_key(meteor_m.meteor(pairs, stem_stage=True))
    assert stem[9]["meteor"] > exact[9]["meteor"]   # runner/runners, runs/ran...
    for k, _, _ in PAIRS:
        assert stem[k]["meteor"] >= exact[k]["meteor"] - 1e-9


def test_properties_identical_and_disjoint(pairs):
    r = by_key(overlap.rouge_n(pairs))
    c = by_key(chrf_m.chrf(pairs))
    assert r[1]["rouge1_f"] == 1.0 and r[4]["rouge1_f"] == 1.0 and c[1]["chrf"] == pytest.approx(100.0)
    assert r[2]["rouge1_f"] == 0.0 and r[2]["rouge2_f"] == 0.0


def test_swapping_sides_swaps_precision_and_recall(pairs):
    from pyspark.sql import functions as F
    sw = pairs.select("pair_id", F.col("predicted").alias("gold"), F.col("gold").alias("predicted"))
    a, b = by_key(overlap.rouge_n(pairs)), by_key(overlap.rouge_n(sw))
    for k, _, _ in PAIRS:
        assert a[k]["rouge1_p"] == b[k]["rouge1_r"] and a[k]["rouge2_r"] == b[k]["rouge2_p"]


def test_row_count_out_equals_pairs_in(pairs):
    for fn in (overlap.rouge_n, overlap.bleu, chrf_m.chrf, meteor_m.meteor, lcs.rouge_l, lcs.rouge_stemmed):
        assert fn(pairs).count() == len(PAIRS)


def test_empty_token_side_scores_zero(pairs):
    r = by_key(overlap.rouge_n(pairs))
    assert r[5]["rouge1_f"] == 0.0   # gold is punctuation only
    assert by_key(lcs.rouge_l(pairs))[5]["rougeL_f"] == 0.0


def test_chrf_udf_equals_relational_form(pairs):
    a = by_key(chrf_m.chrf(pairs))
    b = by_key(chrf_m.chrf_relational(pairs))
    for k, _, _ in PAIRS:
        assert a[k]["chrf"] == pytest.approx(b[k]["chrf"], abs=1e-9)


def test_cloze_top_words_and_lookups_agree(spark):
    from conftest import SMOKE
    from quillmark.operators.metrics.cloze import cloze_gain
    from quillmark.sources import tables as tb
    p, docs = tb.pairs_lead(spark, SMOKE), tb.table(spark, SMOKE, "documents")
    light = sorted(tuple(r) for r in cloze_gain(p, docs, top=1000).collect())
    heavy = sorted(tuple(r) for r in cloze_gain(p, docs, top=1).collect())
    assert light == heavy and any(r[2] > 0 for r in light)


def test_bleu_multi_ref_single_reference_equals_bleu(pairs):
    from pyspark.sql import functions as F
    refs = pairs.select("pair_id", F.lit(0).alias("ref_id"), "gold")
    a = by_key(overlap.bleu_multi_ref(pairs.select("pair_id", "predicted"), refs))
    b = by_key(overlap.bleu(pairs))
    for k, _, _ in PAIRS:
        assert a[k]["bleu"] == b[k]["bleu"] and a[k]["p1"] == b[k]["p1"]


def test_bleu_multi_ref_clips_by_best_reference(spark):
    hyp = spark.createDataFrame([(1, "a a b")], "pair_id long, predicted string")
    refs = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a a")], "pair_id long, ref_id int, gold string")
    r = overlap.bleu_multi_ref(hyp, refs).first()
    assert r["p1"] == pytest.approx(1.0) and r["reference_length"] == 2


def test_meteor_synonym_stage(spark):
    df = spark.createDataFrame([(1, "big house now", "large house now")], "pair_id long, gold string, predicted string")
    syn = spark.createDataFrame([("big", 1), ("large", 1)], "token string, synset int")
    exact = meteor_m.meteor(df).first()["meteor"]
    both = meteor_m.meteor(df, synonyms=syn).first()["meteor"]
    assert both > exact
    assert both == pytest.approx(meteor("a b c", "a b c"), abs=1e-6)   # all three aligned in one chunk
