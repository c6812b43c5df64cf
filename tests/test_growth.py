"""What a metric moves and makes must follow its input; each failed with an earlier plan."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import meteor, rouge_n
from conftest import PAIRS
from quillmark.functions.counting import best_clipped_matches, list_codes
from quillmark.operators.metrics import meteor as meteor_m
from quillmark.operators.metrics import overlap


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", [overlap.rouge_n, overlap.bleu, meteor_m.meteor])
def test_pair_metrics_move_no_text(pairs, metric):
    p = plan(metric(pairs))
    assert "Exchange" not in p and "Generate" not in p


def test_references_make_no_row_an_ngram(spark, pairs):
    refs = pairs.select("pair_id", F.lit(0).alias("ref_id"), "gold")
    p = plan(overlap.bleu_multi_ref(pairs.select("pair_id", "predicted"), refs))
    assert "Generate" not in p and p.count("Exchange") == 1


def test_rows_of_one_key_are_counted_together(spark):
    twice = spark.createDataFrame([PAIRS[6], PAIRS[6], PAIRS[8], (None, "a b", "a b")],
                                  "pair_id long, gold string, predicted string")
    got = {r["pair_id"]: r for r in overlap.rouge_n(twice).collect()}
    assert len(got) == 3
    assert got[7]["rouge1_r"] == pytest.approx(2 * rouge_n(*PAIRS[6][1:], 1)[1], abs=1e-6)
    assert got[9]["rouge1_r"] == pytest.approx(rouge_n(*PAIRS[8][1:], 1)[1], abs=1e-6)
    assert got[None]["rouge2_f"] == 1.0
    m = [(r["pair_id"], r["meteor"]) for r in meteor_m.meteor(twice).collect()]
    assert len(m) == 4 and dict(m)[9] == pytest.approx(meteor(*PAIRS[8][1:]), abs=1e-6)


def test_clipped_by_the_best_reference():
    lists = [[("a b a b".split(), -1), ("a b".split(), 0), ("b a b a".split(), 1)], [], [("a".split(), -1)]]
    offs = [0, 3, 3, 4]
    toks = pa.array([t for row in lists for t, _ in row], pa.list_(pa.string()))
    import numpy as np
    got = best_clipped_matches(np.array([-1, 0, 1, -1]), np.array(offs), list_codes(toks)[0], 3)
    for row, found in zip(lists, got, strict=True):
        for n in (1, 2, 3):
            c = defaultdict(Counter)
            for t, s in row:
                c[s] += Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
            assert found[n - 1] == sum((c[-1] & (c[0] | c[1])).values())


def test_vectors_travel_once_a_block(spark):
    """300 pairs of three tokens: no join or cogroup input has a row a pair and token, however many vectors."""
    from quillmark.operators.metrics import vectors
    pairs = spark.range(300).select(F.col("id").alias("pair_id"), F.lit("a b c").alias("gold"), F.lit("c d").alias("predicted"))
    ids = spark.createDataFrame([(t, i) for i, t in enumerate("abcd")], "token string, vec_id long")
    vecs = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    out = vectors.embedding_match(pairs, ids, vecs)
    p = plan(out)
    assert "FlatMapCoGroupsInArrow" in p and "collect_list(embedding" not in p and "_salt" not in p
    rows = {tuple(r)[1:] for r in out.collect()}
    assert rows == {(0.5, 0.333333, 0.4)}


def test_null_vector_is_none(spark):
    from quillmark.operators.metrics import vectors
    pairs = spark.createDataFrame([(1, "a b", "a"), (2, "b", "b")], "pair_id long, gold string, predicted string")
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "token string, vec_id long")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "vec_id long, embedding array<float>")
    got = {r["pair_id"]: (r["em_f"], r["mover_score"]) for r in vectors.vector_scores(pairs, ids, vecs).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, None)}


PERPLEXITY_TEXTS = [
    (1, "The cat sat. The cat sat on THE mat İstanbul Kelvin"), (2, "the cat ran"), (2, "a dog ran, the cat sat"), (3, None),
    (4, "..."), (None, "the mat the mat"), (5, "word " * 40), (6, "café naïve x1y2"), (7, ""), (8, "sat")]


def perplexities(train, scored):
    """``key: (tokens, perplexity)`` by loops; rows of one key are one text's, null keys have none."""
    import math
    import re

    def grams(text):
        t = re.findall("[a-z0-9]+", (text or "").lower())
        return list(zip(["<s>", *t], t))
    c = Counter(g for text in train for g in grams(text))
    prefix = Counter()
    for (v, _), n in c.items():
        prefix[v] += n
    size = len({w for _, w in c}) + 1
    found = defaultdict(list)
    for k, text in scored:
        found[k] += [math.log((c[g] + 0.1) / (prefix[g[0]] + 0.1 * size)) for g in grams(text) if k is not None]
    return {k: (len(x), round(math.exp(-sum(x) / len(x)), 4) if x else None) for k, x in found.items()}


@pytest.mark.parametrize("size", [1 << 24, 16])
def test_perplexity_in_blocks(spark, monkeypatch, size):
    """The same in one block and in many, with the training texts scored and with others."""
    from quillmark.operators.metrics import lm
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    docs = spark.createDataFrame(PERPLEXITY_TEXTS, "doc_id long, text string").repartition(3)
    others = [(k, (t or "")[::-1] + " the cat") for k, t in PERPLEXITY_TEXTS]
    train = [t for _, t in PERPLEXITY_TEXTS]
    for scored, rows in ((docs, PERPLEXITY_TEXTS), (spark.createDataFrame(others, "doc_id long, text string"), others)):
        got = lm.lm_perplexity(docs, scored)
        assert "Generate" not in plan(got)   # no row a token
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            n, p = perplexities(train, rows)[r["doc_id"]]
            assert r["n_tokens"] == n and r["perplexity"] == (p if p is None else pytest.approx(p, abs=1e-4))


def test_blocks_are_cut_by_bytes():
    from quillmark.operators.metrics.lm import text_blocks
    texts = ["aa", "bbb", "", "c" * 50, "d", "ee"]
    batches = [pa.record_batch([pa.array(range(len(t))), pa.array(t)], ["k", "t"]) for t in (texts[:4], texts[4:])]
    cut = [t.column("t").to_pylist() for t in text_blocks(iter(batches), 5)]
    assert sum(cut, []) == texts and cut == [["aa", "bbb"], ["", "c" * 50], ["d", "ee"]]


def test_word_codes_are_the_tokeniser(spark):
    from quillmark.functions import text as tx
    from quillmark.functions.counting import word_codes
    rows = [t for _, t in PERPLEXITY_TEXTS if t is not None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    want = [r[0] for r in df.orderBy("i").select(tx.tok("t")).collect()]
    low = [r[0] for r in df.orderBy("i").selectExpr("lower(t)").collect()]
    code, offs, words = word_codes(pa.array(["zz", *low]).slice(1))
    words = words.to_pylist()
    assert [[words[c] for c in code[a:b]] for a, b in zip(offs, offs[1:])] == want
    assert word_codes(pa.array([], pa.string()))[1].tolist() == [0]


def cloze_hits(rows, corpus):
    """``key: [masked, base, help, tune]`` by loops."""
    import re

    def toks(text):
        return re.findall("[a-z0-9]+", (text or "").lower())
    follows = defaultdict(Counter)
    for text in corpus:
        t = toks(text)
        for v, w in zip(["<s>", *t], t):
            if len(w) >= 4:
                follows[v][w] += 1

    def best(scores):
        return min(scores, key=lambda s: (-s[0], s[1]), default=(0, None))[1]
    out = {}
    for key, gold, predicted in rows:
        g, h = toks(gold), toks(predicted)
        own = Counter((v, w) for v, w in zip(["<s>", *h], h) if len(w) >= 4)
        hits = [0] * 4
        for i in range(5, len(g), 6):
            if len(g[i]) < 4:
                continue
            v, c = g[i - 1], follows[g[i - 1]]
            base = best([(n, w) for w, n in c.items()])
            helped = best([(n, w) for w, n in c.items() if w in h])
            top = [(c[base], base)] if base else []
            tuned = best([(c[w] + 10 * n, w) for (x, w), n in own.items() if x == v] + top)
            hits = [a + b for a, b in zip(hits, (1, base == g[i], (helped or base) == g[i], tuned == g[i]))]
        out[key] = hits if key is not None else [0] * 4
    return out


@pytest.mark.parametrize("size,top", [(1 << 24, 64), (64, 64), (300, 1), (64, 2)])
def test_cloze_in_blocks(spark, monkeypatch, size, top):
    """The same however texts are cut and few top words are kept; no row a masked word or candidate."""
    import random

    from quillmark.operators.metrics import cloze, lm
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    rnd = random.Random(5)
    words = ["the", "of", "Café", *[f"word{chr(97 + i)}{chr(97 + i // 2)}" for i in range(40)]]

    def text(n):
        return " ".join(words[min(int(rnd.expovariate(0.12)), len(words) - 1)] for _ in range(n))
    corpus = [text(n) for n in (60, 40, 0, 90, 5)] + [None]
    rows = [(k, text(rnd.choice((0, 4, 7, 30, 80))), text(rnd.choice((0, 1, 12, 40)))) for k in range(25)]
    rows += [(None, text(30), text(30)), (90, None, text(20)), (91, text(30), None), (92, "zzzz " * 20, text(9)),
             (93, "a b c d e unseen " * 4, "e other e unseen")]
    p = spark.createDataFrame(rows, "pair_id long, gold string, predicted string").repartition(3)
    got = cloze.cloze_gain(p, spark.createDataFrame([(t,) for t in corpus], "text string"), top=top)
    assert "Generate" not in plan(got)
    got = {r["pair_id"]: [r[c] for c in ("masked", "base_correct", "help_correct", "tune_correct")] for r in got.collect()}
    assert got == cloze_hits(rows, corpus)


def test_bpe_folds_words_together(spark):
    """All words a step at a time, as the tokenizer library; no table is a literal of the plan."""
    import random

    import public_tokenizers
    import tiktoken

    from quillmark.llm import bpe
    codec, rnd = bpe.codec(), random.Random(3)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    words = ["", "a", "é" * 30, "ab" * 400, "", *["".join(rnd.choices("aeinorst hl", k=rnd.randint(1, 30))) for _ in range(500)], ""]
    assert bpe.folded_words(words, *codec.tables, codec.size).to_pylist() == [library.encode_ordinary(w) for w in words]
    assert bpe.folded_words([], *codec.tables, codec.size).to_pylist() == []
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    p = bpe.encoded(docs, codec)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in p and "Project [doc_id" not in p.split("MapInArrow")[0]


def test_composite_scores_are_made_once(spark):
    """The run's statistics and the rows read the same scores; these ran twice before."""
    from quillmark.operators import analysis as an
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        made.add(1)
        return float(i) if i else None

    got = an.composite_score(spark.range(5).select(F.col("id").alias("pair_id"), score("id").alias("m"), F.lit(1.0).alias("one")),
                             {"m": 2.0, "one": 1.0})
    rows = dict(tuple(r) for r in got.collect())
    assert made.value == 5
    assert rows == {0: None} | {i: pytest.approx(2 * (i - 2.5) / 1.25 ** 0.5, abs=1e-6) for i in range(1, 5)}


REPEATS = ["a b c a b c", "A b. C a, b c a B c", "a b", "", "...", "x " * 9, "İx y ß z İx y ß z", "a b c", "c a b c a b"]


def test_repeats_make_no_ngram_strings(spark):
    import re

    from quillmark.operators import quality as dq
    df = spark.createDataFrame([*enumerate(REPEATS), (90, None), (None, "a b c a b c"), (0, "a a a a")], "k long, t string")
    for n in (1, 3):
        out = dq.repeat_ngram_rate(df, "k", "t", n)
        assert "array_distinct" not in plan(out) and "Exchange" not in plan(out)
        want = []
        for k, t in df.collect():
            w = re.findall("[a-z0-9]+", (t or "").lower())
            grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
            want.append((k, len(grams), round(1 - len(set(grams)) / len(grams), 6) if grams else None))
        assert [tuple(r) for r in out.collect()] == want


@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_texts_are_counted_in_chunks(monkeypatch, chunk):
    """The same in one chunk and in many, of a slice of a longer column too."""
    from quillmark.functions import counting
    monkeypatch.setattr(counting, "CHUNK_ITEMS", chunk)
    low = pa.array(["zz zz", *[t.lower() for t in REPEATS]])
    a, b = low.slice(1), pa.concat_arrays([low.slice(2), low.slice(0, 1)])
    import re
    toks = [[re.findall("[a-z0-9]+", t) for t in c.to_pylist()] for c in (a, b)]
    want = []
    for g, h in zip(*toks, strict=True):
        grams = [[Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for n in (1, 2)] for t in (g, h)]
        want.append([len(g), len(h), *[(x & y).total() for x, y in zip(*grams, strict=True)]])
    assert counting.text_matches(a, b, 2).tolist() == want
    kinds = [{tuple(t[i:i + 3]) for i in range(len(t) - 2)} for t in toks[0]]
    assert counting.ngram_kinds(a, 3).tolist() == [[max(len(t) - 2, 0), len(k)] for t, k in zip(toks[0], kinds, strict=True)]
    assert counting.ngram_kinds(a.slice(0, 0), 3).shape == (0, 2) and counting.text_matches(a.slice(0, 0), a.slice(0, 0), 2).shape == (0, 4)


def test_rouge_makes_no_token_a_string(spark):
    """Null texts have no tokens and no match, as where the tokens are arrays."""
    from quillmark.functions import text as tx
    rows = spark.createDataFrame([*PAIRS, (20, None, "a b"), (21, "a b", None), (22, None, None), (23, "", "")],
                                 "pair_id long, gold string, predicted string")
    ours = overlap.word_overlap(rows, tx.tok, (1, 2))
    assert "split(" not in plan(ours)
    by_arrays = overlap.word_overlap(rows, lambda c: tx.tok(c), (1, 2))
    assert ours.schema == by_arrays.schema
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, by_arrays.collect()))


def test_grams_are_dealt_alike_by_either_sort():
    import numpy as np

    from quillmark.operators.metrics.lm import dealt_grams, numbers_used
    names = pa.array([f"w{i}" for i in range(50)])
    left, right = np.arange(2000) % 50, np.arange(2000) // 40
    for buckets in (7, 1 << 16, (1 << 16) + 1):
        order, grams, cut = dealt_grams(names, left, right, buckets)
        assert cut[0] == 0 and cut[-1] == 2000 and sorted(order) == list(range(2000))
        assert all((np.diff(order[a:b]) > 0).all() for a, b in zip(cut, cut[1:]))
        assert grams.to_pylist()[:3] == [f"w{left[i]} w{right[i]}" for i in order[:3]]
    x = np.array([5, 2, 5, 0])
    used, place = numbers_used(x, 9)
    assert used.tolist() == [0, 2, 5] and place.tolist() == [2, 1, 2, 0]
    assert [len(a) for a in numbers_used(x[:0], 0)] == [0, 0]
