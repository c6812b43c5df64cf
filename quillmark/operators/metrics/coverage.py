"""

Re-aimed: the reference runs a question-generation / answering model; this
scores the idf-weighted coverage of salient terms in both directions. Same
purpose and output shape (fscore, precision, recall), not the same values.

Terms of a text are its distinct tokens of length >= 4 outside the corpus'
most frequent tokens; a term's weight is its idf over the corpus. With a
transcript, the values against gold and against the transcript are
averaged. Transcript terms are built once per conversation and joined to
predicted terms on ``(conv_id, token)`` — a conversation's transcript is
never repeated for each of its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators.aggregates import idf_table
from quillmark.operators.joins import probe_sample, split_lookup
from quillmark.session import cut_lineage

MIN_TERM_LEN = 4
TOP_FREQUENT = 50


def frequent_tokens(corpus: DataFrame, text: str, k: int = TOP_FREQUENT) -> DataFrame:
    """The ``k`` most frequent tokens (count desc, token): a distributed top-k,
    at most ``k`` rows."""
    c = corpus.select(F.explode(tx.tok(text)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.col("count").desc(), F.col("token").asc()).limit(k).select("token")


def _terms(df: DataFrame, keys: list[str], text: str, stop: DataFrame) -> DataFrame:
    t = df.select(*keys, F.explode(F.array_distinct(tx.tok(text))).alias("token"))
    t = t.where(F.length("token") >= MIN_TERM_LEN)
    # ``stop`` has at most TOP_FREQUENT rows (a limit), so broadcasting it is bounded.
    return t.join(F.broadcast(stop), "token", "left_anti")


def term_weights(corpus: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, "F.Column"]:
    """``(idf(token, idf), stop(token), default weight ln(N+1))`` over a corpus."""
    # Read by the split lookups (total, heavy and light parts) for both the
    # pair and the transcript terms: written once instead of re-aggregated.
    idf = cut_lineage(idf_table(corpus, key, text).select("token", F.col("idf").alias("w"), "df"))
    n_docs = corpus.select(F.count(F.lit(1)).cast("double")).scalar()
    return idf, frequent_tokens(corpus, text), F.log(n_docs + 1.0)


def answer_coverage(pairs: DataFrame, corpus: DataFrame, transcripts: DataFrame | None = None,
                    key: str = "pair_id", conv_key: str = "conv_id") -> DataFrame:
    """``(key, fscore, precision, recall)``.

    ``transcripts`` (``conv_key``, ``transcript``) is optional; pairs whose
    conversation has no (or an empty) transcript are scored against gold only.
    """
    idf, stop, w0 = term_weights(corpus)
    keys = [key] + ([conv_key] if transcripts is not None else [])
    g = _terms(pairs, keys, "gold", stop).withColumn("side", F.lit(0))
    h = _terms(pairs, keys, "predicted", stop).withColumn("side", F.lit(1))
    t = split_lookup(g.unionByName(h), idf, ["token"], ["w"],
                     probe=_terms(probe_sample(pairs), keys, "gold", stop)).withColumn("w", F.coalesce("w", w0))
    per_tok = t.groupBy(*keys, "token", "w").agg(
        F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("in_g"),
        F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("in_h"))
    wg, wh = F.col("w") * F.col("in_g"), F.col("w") * F.col("in_h")
    sums = per_tok.groupBy(*keys).agg(F.sum(wg).alias("Wg"), F.sum(wh).alias("Wh"),
                                      F.sum(wg * F.col("in_h")).alias("Wgh"))
    base = pairs.select(*keys).join(sums, keys, "left").fillna(0.0, ["Wg", "Wh", "Wgh"])
    rec_g = tx.safe_div(F.col("Wgh"), F.col("Wg"))
    prec_g = tx.safe_div(F.col("Wgh"), F.col("Wh"))
    if transcripts is None:
        out = base.select(key, prec_g.alias("precision"), rec_g.alias("recall"))
    else:
        tt = split_lookup(_terms(transcripts, [conv_key], "transcript", stop), idf, ["token"], ["w"]) \
            .withColumn("w", F.coalesce("w", w0))
        present = transcripts.select(conv_key, (F.col("transcript").isNotNull()
                                                & (F.col("transcript") != "")).alias("has_t"))
        wt = present.join(tt.groupBy(conv_key).agg(F.sum("w").alias("Wt")), conv_key, "left")
        th = h.select(key, conv_key, "token").join(tt, [conv_key, "token"]).groupBy(key).agg(
            F.sum("w").alias("Wth"))
        b = base.join(wt, conv_key, "left").join(th, key, "left").fillna(0.0, ["Wt", "Wth"])
        has_t = F.coalesce(F.col("has_t"), F.lit(False))
        rec_t = tx.safe_div(F.col("Wth"), F.col("Wt"))
        prec_t = tx.safe_div(F.col("Wth"), F.col("Wh"))
        out = b.select(key, F.when(has_t, (prec_g + prec_t) / 2).otherwise(prec_g).alias("precision"),
                       F.when(has_t, (rec_g + rec_t) / 2).otherwise(rec_g).alias("recall"))
    return out.select(key, tx.r6(tx.f_measure(F.col("precision"), F.col("recall"))).alias("fscore"),
                      tx.r6(F.col("precision")).alias("precision"), tx.r6(F.col("recall")).alias("recall"))
