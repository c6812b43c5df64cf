"""

LCS is a dynamic program, which no built-in expression expresses
efficiently, so these are Arrow (``pandas_udf``) scorers over token arrays
that Spark has already tokenised in the JVM. The UDFs see one batch of
rows at a time; nothing crosses the driver.

* ROUGE-L: bit-parallel LCS length (Allison & Dix 1986; Hyyrö 2004) on
  Python integers — O(|gold| · |pred| / 64) word operations, no table.
* ROUGE-Lsum: per gold sentence, the union of the gold positions matched
  by an LCS with every predicted sentence; a hit counts while the token
  still has budget in both texts' token counters.
* Stemmed ROUGE: tokens of 4+ characters are Porter-stemmed, each distinct
  token of a batch once, or replaced by a user's stem table; then ROUGE-1/2
  (exact n-gram job), ROUGE-L and ROUGE-Lsum.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as tx
from quillmark.functions.stem import stem_token
from quillmark.operators.joins import probe_sample, split_lookup
from quillmark.operators.metrics.overlap import ngram_overlap


def lcs_length(a, b) -> int:
    """Length of the LCS of two token sequences (bit-parallel)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def lcs_positions(ref, can) -> list[int]:
    """Indices into ``ref`` of one LCS with ``can`` (DP table + backtrack;
    on ties the walk steps along ``ref``).

    ``ref`` tokens that ``can`` lacks are left out of the table: the walk steps
    over them wherever it meets them. ``can`` tokens stay, for they decide ties.
    """
    common = set(can)
    ri = [i for i, t in enumerate(ref) if t in common]
    if not ri:
        return []
    a = [ref[i] for i in ri]
    b = can
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        ai, prev, row = a[i - 1], table[i - 1], table[i]
        for j in range(1, m + 1):
            if ai == b[j - 1]:
                row[j] = prev[j - 1] + 1
            else:
                row[j] = prev[j] if prev[j] >= row[j - 1] else row[j - 1]
    out = []
    i, j = n, m
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.append(ri[i - 1])
            i -= 1
            j -= 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def summary_lcs_hits(gold_sents, pred_sents) -> tuple[int, int, int]:
    """``(hits, gold tokens, pred tokens)`` of the summary-level union LCS."""
    gold_sents = [list(s) for s in gold_sents]
    pred_sents = [list(s) for s in pred_sents]
    budget_g = Counter(t for s in gold_sents for t in s)
    budget_h = Counter(t for s in pred_sents for t in s)
    n_g, n_h = sum(budget_g.values()), sum(budget_h.values())
    hits = 0
    for gs in gold_sents:
        union: set[int] = set()
        for hs in pred_sents:
            union.update(lcs_positions(gs, hs))
        for idx in sorted(union):
            t = gs[idx]
            if budget_g[t] > 0 and budget_h[t] > 0:
                hits += 1
                budget_g[t] -= 1
                budget_h[t] -= 1
    return hits, n_g, n_h


def _prf(match: float, n_g: int, n_h: int) -> tuple[float, float, float]:
    if n_g == 0 or n_h == 0:
        return 0.0, 0.0, 0.0
    p, r = match / n_h, match / n_g
    return p, r, (0.0 if p + r == 0 else 2 * p * r / (p + r))


_PRF = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p", "r", "f")])


@F.pandas_udf(_PRF)
def _rouge_l_udf(g: pd.Series, h: pd.Series) -> pd.DataFrame:
    rows = [_prf(lcs_length(list(a), list(b)), len(a), len(b)) for a, b in zip(g, h)]
    return pd.DataFrame(rows, columns=["p", "r", "f"])


@F.pandas_udf(_PRF)
def _rouge_lsum_udf(g: pd.Series, h: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(g, h):
        hits, n_g, n_h = summary_lcs_hits(a, b)
        rows.append(_prf(hits, n_g, n_h))
    return pd.DataFrame(rows, columns=["p", "r", "f"])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_sentences(sents: pa.Array) -> pa.Array:
    """Porter stems of the tokens of 4+ characters (shorter tokens unchanged) of
    sentences; each distinct token of a batch is stemmed once."""
    lines = sents.flatten()
    words = lines.flatten().dictionary_encode()
    stems = pa.array([stem_token(t) for t in words.dictionary.to_pylist()], pa.string()).take(words.indices)

    def nested(like: pa.Array, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(like.value_lengths())), pa.int32()), values)

    return nested(sents, nested(lines, stems))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _replaced(sents: pd.Series, tokens: pd.Series, stems: pd.Series) -> pd.Series:
    out = []
    for rows, k, v in zip(sents, tokens, stems, strict=True):
        by = {} if k is None else dict(zip(k, v, strict=True))
        out.append([[by.get(t, t) for t in line] for line in rows])
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def stem_words(s: pd.Series) -> pd.Series:
    return s.map(stem_token)


def stem_table(tokens: DataFrame) -> DataFrame:
    """``(token, stem)`` for a table of (distinct) tokens."""
    return tokens.select("token", stem_words("token").alias("stem"))


def _emit(df: DataFrame, key: str, name: str) -> DataFrame:
    s = F.col("s")
    return df.select(key, tx.r6(s["p"]).alias(f"{name}_p"), tx.r6(s["r"]).alias(f"{name}_r"),
                     tx.r6(s["f"]).alias(f"{name}_f"))


def rouge_l(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """MET-2: ``L = LCS(tok(gold), tok(pred))``; P = L/|pred|, R = L/|gold|.

    Row-local: tokenised in the JVM, scored in the UDF, no exchange.
    """
    tp = pairs.select(key, tx.tok("gold").alias("g"), tx.tok("predicted").alias("h"))
    return _emit(tp.select(key, _rouge_l_udf("g", "h").alias("s")), key, "rougeL")


def _sentence_tokens(c: str):
    return F.transform(F.split(F.coalesce(tx.sentence_lines(c), F.lit("")), "\n"), lambda s: tx.tok(s))


def rouge_lsum(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """MET-3: summary-level union LCS over sentences (PRJ-7 rule, one per line)."""
    sp = pairs.select(key, _sentence_tokens("gold").alias("g"), _sentence_tokens("predicted").alias("h"))
    return _emit(sp.select(key, _rouge_lsum_udf("g", "h").alias("s")), key, "rougeLsum")


def _with_stems(sp: DataFrame, stems: DataFrame, key: str) -> DataFrame:
    """``sp`` (``key, gs, hs``) with tokens replaced by those of a ``token, stem`` table.

    Each pair's distinct tokens are looked up once (hot ones map-side) and come
    back as one short list a pair; the texts themselves stay where they are.
    """
    def tokens(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.explode(F.array_distinct(F.flatten(F.concat("gs", "hs")))).alias("token"))

    found = split_lookup(tokens(sp), stems.select("token", "stem"), ["token"], ["stem"], probe=tokens(probe_sample(sp)))
    found = found.where(F.col("stem").isNotNull()).groupBy(key).agg(F.collect_list(F.struct("token", "stem")).alias("_s"))
    j = sp.join(found, key, "left").withColumn("_t", F.col("_s.token")).withColumn("_s", F.col("_s.stem"))
    return j.select(key, _replaced("gs", "_t", "_s").alias("gs"), _replaced("hs", "_t", "_s").alias("hs"))


def rouge_stemmed(pairs: DataFrame, key: str = "pair_id", stems: DataFrame | None = None) -> DataFrame:
    """MET-4: ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum on stems, each with P, R and F.

    Porter stems, each distinct token of a batch stemmed once where it stands;
    or, with ``stems``, a user's ``token, stem`` table (tokens it lacks stay).
    One move of the texts: the LCS scores are computed next to the stemmed
    sentences and carried through the n-gram aggregation as group keys.
    """
    sp = pairs.select(key, _sentence_tokens("gold").alias("gs"), _sentence_tokens("predicted").alias("hs")).repartition(key)
    if stems is None:
        sp = sp.select(key, stem_sentences("gs").alias("gs"), stem_sentences("hs").alias("hs"))
    else:
        sp = _with_stems(sp, stems, key)
    tp = sp.select(key, "gs", "hs", F.flatten("gs").alias("g"), F.flatten("hs").alias("h"))
    tp = tp.select(key, "g", "h", _rouge_l_udf("g", "h").alias("l"), _rouge_lsum_udf("gs", "hs").alias("ls"))
    ov = ngram_overlap(tp, (1, 2), key, extra=("l", "ls"))
    cols = []
    for n in (1, 2):
        o = F.col(f"ov_{n}")
        p = o / F.greatest(F.col("lh") - (n - 1), F.lit(1))
        r = o / F.greatest(F.col("lg") - (n - 1), F.lit(1))
        cols += [tx.r6(p).alias(f"rouge{n}_p"), tx.r6(r).alias(f"rouge{n}_r"), tx.r6(tx.f_measure(p, r)).alias(f"rouge{n}_f")]
    for c, name in (("l", "rougeL"), ("ls", "rougeLsum")):
        cols += [tx.r6(F.col(c)[x]).alias(f"{name}_{x}") for x in ("p", "r", "f")]
    return ov.select(key, *cols)
