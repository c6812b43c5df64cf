import math

import numpy as np
import pytest

from quillmark.operators.metrics import vectors as vec_m
from quillmark.operators.metrics.learned import learned_score
from quillmark.operators.registry import LENGTH_RATIO_SCHEMA, load, make_length_ratio_scorer, score_with


def _tables(spark):
    vecs = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [1.0, 1.0]}
    vec_ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, vec_id long")
    vectors = spark.createDataFrame([(k, v) for k, v in vecs.items()], "vec_id long, embedding array<float>")
    return vec_ids, vectors, vecs


def brute(gold, pred, vecs, ids):
    unit = {t: np.asarray(vecs[ids[t]]) / np.linalg.norm(vecs[ids[t]]) for t in ids}
    g = [unit[t] for t in gold if t in unit]
    h = [unit[t] for t in pred if t in unit]
    bh = [max(float(x @ y) for y in g) for x in h]
    bg = [max(float(x @ y) for y in h) for x in g]
    p, r = sum(bh) / len(bh), sum(bg) / len(bg)
    d = lambda c: math.sqrt(max(2 - 2 * c, 0))
    rw = max(sum(map(d, bh)) / len(bh), sum(map(d, bg)) / len(bg))
    return p, r, 1 - rw


def test_vector_scores_match_brute_force(spark):
    vec_ids, vectors, vecs = _tables(spark)
    ids = {"a": 0, "b": 1, "c": 2}
    rows = [(1, "a b", "a a c"), (2, "a", "a"), (3, "c b", "z a"), (4, "zz", "a")]
    df = spark.createDataFrame(rows, "pair_id long, gold string, predicted string")
    got = {r["pair_id"]: r for r in vec_m.vector_scores(df, vec_ids, vectors).collect()}
    for k, g, h in rows[:3]:
        p, r, m = brute(g.split(), h.split(), vecs, ids)
        assert got[k]["em_p"] == pytest.approx(p, abs=1e-6)
        assert got[k]["em_r"] == pytest.approx(r, abs=1e-6)
        assert got[k]["mover_score"] == pytest.approx(m, abs=1e-6)
    assert got[2]["em_f"] == pytest.approx(1.0)
    assert got[4]["em_f"] == 0.0 and got[4]["mover_score"] is None   # gold has no vector


def test_registry_and_score_with(spark, pairs):
    assert load("rouge") is not None
    with pytest.raises(KeyError):
        load("nope")
    out = {r["pair_id"]: r["length_ratio"] for r in
           score_with(pairs, make_length_ratio_scorer, LENGTH_RATIO_SCHEMA).collect()}
    assert out[1] == 1.0 and len(out) == 10


def test_learned_score_is_rescaled(spark):
    rows = [(i, float(i), float(i % 3), 2.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "pair_id long, x1 double, x2 double, y double")
    out = learned_score(df, ["x1", "x2"], "y").collect()
    vals = sorted(r["learned_score"] for r in out)
    assert len(vals) == 20 and 0.0 <= vals[0] <= vals[-1] <= 100.0
    assert sum(vals) / 20 == pytest.approx(50.0, abs=1e-4)


def test_mover_score_idf_matches_brute_force(spark):
    """Weights by count times idf of the own side, the mean over a pair's references."""
    vec_ids, vectors, vecs = _tables(spark)
    ids = {"a": 0, "b": 1, "c": 2}
    hyps = {1: "a a c", 2: "b", 3: "zz", 4: None}
    refs = [(1, 0, "a b"), (1, 1, "c c b"), (1, 2, "zz"), (2, 0, "a b b"), (3, 0, "a"), (4, 0, "c"), (2, 1, None)]
    got = {r["pair_id"]: r for r in vec_m.mover_score_idf(
        spark.createDataFrame(list(hyps.items()), "pair_id long, predicted string"),
        spark.createDataFrame(refs, "pair_id long, ref_id int, gold string"), vec_ids, vectors).collect()}

    def idf(texts):
        sets = [set((t or "").split()) for t in texts]
        return {t: round(math.log((len(sets) + 1) / (sum(t in s for s in sets) + 1)), 6) for s in sets for t in s}

    def bag(text, weight):
        found = [t for t in (text or "").split() if t in ids and weight[t] > 0]
        return [(np.asarray(vecs[ids[t]]) / np.linalg.norm(vecs[ids[t]]), weight[t]) for t in found]

    def far(xs, ys):
        d = [(w, min(math.sqrt(max(2 - 2 * float(x @ y), 0)) for y, _ in ys)) for x, w in xs]
        return sum(w * v for w, v in d) / sum(w for w, _ in d)
    of_g, of_h = idf([g for *_, g in refs]), idf(hyps.values())
    for k, text in hyps.items():
        h = bag(text, of_h)
        pairs = [(bag(g, of_g), h) for i, _, g in refs if i == k]
        want = [1 - max(far(x, y), far(y, x)) for x, y in pairs if x and y]
        assert got[k]["references"] == len(want)
        assert got[k]["mover_score_idf"] == (pytest.approx(np.mean(want), abs=1e-6) if want else None)
    assert got[1]["references"] == 2


def test_mover_score_idf_moves_a_vector_once_a_block(spark):
    """No vector is gathered for a pair or a token, and rows that share a key are one text."""
    vec_ids, vectors, _ = _tables(spark)
    hyps = spark.createDataFrame([(1, "a a"), (1, "c"), (2, "b"), (None, "a"), (5, "c")], "pair_id long, predicted string")
    refs = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, None), (None, 0, "b"), (3, 0, "a c"), (5, 1, "c a"), (5, None, "b")],
                                 "pair_id long, ref_id int, gold string")
    out = vec_m.mover_score_idf(hyps, refs, vec_ids, vectors)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "embedding" in x]
    got = sorted(map(tuple, out.collect()), key=str)
    assert [(k, n) for k, n, _ in got] == [(1, 1), (1, 1), (2, 0), (5, 2), (None, 0)]
    assert [s is None for *_, s in got] == [False, False, True, False, True] and got[0] == got[1]
