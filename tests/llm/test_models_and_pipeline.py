"""Classifiers, embeddings, the pipeline and the queries' contracts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import catalog, minhash, mixing, quality, toxicity, vectors
from quillmark.llm.graph import UnionFind

from .conftest import fold, prose

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op10_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r["held_out"] == (fold(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[x["doc_id"]]["score"], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert auc(held) > 0.95
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op1_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r["held_out"] == (fold(i, 4) == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[x["doc_id"]]["score"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert auc(held) > 0.8
    assert np.mean([s < 0.3 for s, y in held if not y]) > 0.95


def test_classifiers_on_edge_cases(spark, docs, no_docs, labels, fixture_rows):
    for model in (quality, toxicity):
        got = model.classify(docs, labels).collect()
        assert len(got) == len(fixture_rows) and all(0 <= r["score"] <= 1 for r in got)
        by = {r["doc_id"]: r["score"] for r in got}
        assert by[0] == by[1] and by[6] == by[7]      # equal texts; null is empty
        assert model.classify(no_docs, labels).collect() == []
        assert model.classify(docs, labels.limit(0)).count() == len(fixture_rows)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and set(r["score"] for r in kept.collect()) <= {"clash"}


def test_labels_of_the_held_out_fold_are_not_read(spark, docs, labels):
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {tuple(r) for r in quality.classify(docs, labels).collect()} == {
        tuple(r) for r in quality.classify(docs, turned).collect()}


def test_non_negative_risk_learns_from_unlabelled_text():
    rng = np.random.default_rng(3)
    toxic = (rng.random((200, 20)) < 0.1).astype(np.float32)   # confirmed rows are like the hidden ones
    toxic[:, 0] = 1
    rest = (rng.random((1000, 20)) < 0.1).astype(np.float32)
    rest[:, 0] = np.arange(1000) < 150       # the unlabelled text holds the prior's share of toxic rows
    w, b = toxicity.fit(toxic, rest, 0.15)
    score = 1 / (1 + np.exp(-(rest @ w + b)))
    assert np.mean((score >= 0.3) == (np.arange(1000) < 150)) > 0.97
    assert auc(list(zip(score, np.arange(1000) < 150, strict=True))) > 0.99


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16)).astype(np.float32)
    near = base[:10] + rng.standard_normal((10, 16)).astype(np.float32) * 0.15
    x = [*base, *near, *base[:3], *(base[:2] * 2)]
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [math.inf], [1.0, 2.0]]
    rows += [(100 + i, v, "clash") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    m = np.array(x, np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.9
    sets = UnionFind()
    for i, j in zip(*np.nonzero(close), strict=True):
        sets.union(int(i), int(j))
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.9 * (close.sum() - len(x))
    for i in range(len(x)):
        assert got[i]["n_links"] <= close[i].sum() - 1
        assert sets.find(got[i]["component_id"]) == sets.find(i) and got[i]["kept"] == (got[i]["component_id"] == i)
    assert got[40]["component_id"] == got[0]["component_id"] == 0
    assert all(got[100 + i][1:] == (0, 100 + i, True) for i in range(len(bad)))
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_vectors_without_ids_and_repeated_rows(spark):
    """Rows without an id take no part, with or without a named twin; repeated rows link with each other."""
    a, b, c = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5], [0.1, -9.0, 4.0]
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (7, c), (7, c)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 1, 1, True), (2, 1, 1, False), *[(None, 0, None, True)] * 3, *[(7, 1, 7, True)] * 2], key=str)


def test_vectors_recall(spark):
    """All links of a whole table against brute force."""
    got = {r["vec_id"]: r["n_links"] for r in catalog.QUERIES["op9_vectors"](spark, "/root/testdata/sf0.1").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    m = np.array([r["embedding"] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    n = (m @ m.T >= 0.9).sum(1) - 1
    assert all(got[r["vec_id"]] <= k for r, k in zip(rows, n, strict=True))
    assert sum(got.values()) >= 0.9 * n.sum()


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids"]
    got = rows.collect()
    assert got and all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_pipeline_stages_keep_columns(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, no_docs):
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
            out.count()


def test_pipeline_keeps_one_of_each_group_at_80(spark):
    """The stage's ids against brute force, with pairs on both sides of 0.80 and up to 0.85."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base))]
    for k in range(2, 12):   # k - 1 changed words, 5 shingles each: from 0.975 down to 0.775
        words = list(base)
        for c in range(k - 1):
            words[7 + c * 35 + k] = f"n{k}x{c}"
        rows.append((k, " ".join(words)))
    # Apart from those: pairs of 100 words that share 0.81 and 0.79 of their shingles.
    for first, n in ((100, 10), (200, 11)):
        text = [f"t{first}y{i}" for i in range(100)]
        rows += [(first, " ".join(text)), (first + 1, " ".join(text[:-n] + [f"z{first}y{i}" for i in range(n)]))]
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    share = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert any(80 <= x < 85 for x in share.values()) and any(75 < x < 80 for x in share.values())
    groups = UnionFind()
    for (a, b), x in share.items():
        if x >= 80:
            groups.union(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({groups.find(i) for i in sets})
    assert minhash.scheme(85) == (85, 24, 120, 84)


def test_pipeline_rows_with_repeated_and_null_ids(spark):
    """Shared and missing ids: one row of each group stays, and the mix takes its words once."""
    copy, other = prose(31, 80), prose(32, 90)
    rows = [(1, copy, "a"), (1, copy, "b"), (1, other, "a"), (2, copy, "a"), (None, copy, "a"),
            *[(None, prose(40 + i, 60 + i), "ab"[i % 2]) for i in range(6)], (None, prose(40, 60), "a"),
            (None, other, "b"), (7, prose(60, 50), "b"), (7, prose(61, 50), "b"), (None, None, None), (7, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted(
        str(t) for t in [*{t for _, t, _ in rows if t}, None, ""])
    assert {r["doc_id"] for r in kept if r["text"] in (copy, other)} == {1}

    def words(found):
        out = {}
        for r in found:
            out[r["source"]] = out.get(r["source"], 0) + len((r["text"] or "").split())
        return out

    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert words(mixed) == taken
    again = corpus_pipeline.mix_sources(spark, docs.orderBy(F.length("text")).coalesce(1), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracles(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    rows = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in rows.description]
    want = sorted(map(str, rows.fetchall()))
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_prose_is_reproducible():
    assert prose(1, 5) == prose(1, 5)
