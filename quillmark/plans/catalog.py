"""

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's full tables. Oracle SQL for the same names is in
:mod:`quillmark.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.metrics import overlap
from quillmark.sources import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- counting metrics -------------------------------------------------------

@query("rouge_n")
def q_rouge_n(spark, d):
    return overlap.rouge_n(tb.pairs_conv(spark, d))


@query("rouge_n_lead")
def q_rouge_n_lead(spark, d):
    return overlap.rouge_n(tb.pairs_lead(spark, d))


@query("bleu")
def q_bleu(spark, d):
    return overlap.bleu(tb.pairs_conv(spark, d))


@query("bleu_lead")
def q_bleu_lead(spark, d):
    return overlap.bleu(tb.pairs_lead(spark, d))


@query("bleu_corpus")
def q_bleu_corpus(spark, d):
    return overlap.bleu_corpus(tb.pairs_conv(spark, d), by="conv_id")


# --- shared builders ----------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from quillmark.functions import text as tx  # noqa: E402
from quillmark.operators import aggregates as ag  # noqa: E402
from quillmark.operators import analysis as an  # noqa: E402
from quillmark.operators import pairs as pr  # noqa: E402
from quillmark.operators import quality as dq  # noqa: E402
from quillmark.operators import tokens as tk  # noqa: E402
from quillmark.operators.metrics import lm  # noqa: E402
from quillmark.sources import io  # noqa: E402

# Fixed parameters of the fixture queries.
MAX_SOURCE = 64
MAX_TARGET = 32
MAX_SAMPLES = 500
CAP_N = 50
PREVIEW_N = 20
REQUIRED_SPLITS = ["train", "validation", "test", "holdout"]
ANALYSIS_METRICS = ["rouge1_f", "perplexity", "repeat_rate", "n_tokens"]
ORIENTATION = {"perplexity": -1, "repeat_rate": -1}
COMPOSITE_WEIGHTS = {"rouge1_f": 1.0, "perplexity": -1.0, "repeat_rate": -1.0}
ERROR_TYPES = ["low_quality", "toxic"]


def conv_vocab(spark, d):
    return tk.build_vocab(tb.pairs_conv(spark, d), ["gold", "predicted"])


def conv_encoded(spark, d):
    p = tb.pairs_conv(spark, d)
    return tk.encode_truncate_pad(p, conv_vocab(spark, d), "pair_id", "gold", "predicted",
                                  MAX_SOURCE, MAX_TARGET)


def ids_str(c: str):
    return F.array_join(F.col(c), ",").alias(c)


def doc_scores(spark, d, metrics=("rouge1_f", "perplexity", "repeat_rate", "n_tokens")):
    """Per labelled document, with system and architecture, the asked of: ROUGE-1
    vs its benchmark passage, bigram perplexity (model counted on all documents)
    and token count, trigram repeat rate."""
    p = tb.pairs_doc(spark, d)
    out = p.select("pair_id", "system", "arch")
    if "rouge1_f" in metrics:
        out = out.join(overlap.rouge_n(p, ns=(1,)).select("pair_id", "rouge1_f"), "pair_id")
    if {"perplexity", "n_tokens"} & set(metrics):
        out = out.join(lm.lm_perplexity(tb.table(spark, d, "documents"), p.select("pair_id", "predicted"),
                                        key="pair_id", text="predicted"), "pair_id")
    if "repeat_rate" in metrics:
        out = out.join(dq.repeat_ngram_rate(p, "pair_id", "predicted").select("pair_id", "repeat_rate"), "pair_id")
    return out.select("pair_id", "system", "arch", *metrics)


def doc_correlations(spark, d):
    return an.metric_error_correlation(doc_scores(spark, d), tb.ann_doc(spark, d), ANALYSIS_METRICS)


# --- sources and sinks ----------------------------------------------------------

@query("read_pairs")
def q_read_pairs(spark, d):
    p = tb.pairs_conv_with_transcript(spark, d).select("pair_id", "gold", "predicted", "transcript")
    path = io.scratch_path(spark, "pairs")
    io.write_pairs_csv(p, path)
    return io.read_pairs(spark, path)


@query("write_scores")
def q_write_scores(spark, d):
    s = overlap.rouge_n(tb.pairs_conv(spark, d))
    path = io.scratch_path(spark, "scores")
    io.write_scores(s, path)
    return io.read_scores(spark, path, s.schema)


@query("write_run_results")
def q_write_run_results(spark, d):
    p = tb.pairs_conv(spark, d)
    s = overlap.rouge_n(p).select("pair_id", "rouge1_f", "rouge2_f")
    s = pr.scale_round(s, ["rouge1_f", "rouge2_f"])
    out = p.select("pair_id", F.col("predicted").alias("prediction"), F.col("gold").alias("label")) \
        .join(s, "pair_id").withColumn("run_id", F.lit("run1")) \
        .withColumn("split", F.when(F.col("pair_id") % 2 == 0, F.lit("eval")).otherwise(F.lit("test")))
    path = io.scratch_path(spark, "runs")
    io.write_run_results(out, path)
    schema = "pair_id long, prediction string, label string, rouge1_f double, rouge2_f double, " \
             "run_id string, split string"
    return spark.read.schema(schema).options(header="true", escape='"', multiLine="true").csv(path)


@query("write_predictions_text")
def q_write_predictions_text(spark, d):
    p = tb.pairs_conv(spark, d)
    path = io.scratch_path(spark, "preds")
    io.write_predictions_text(p, path)
    return io.read_predictions_text(spark, path)


@query("read_splits")
def q_read_splits(spark, d):
    docs = tb.documents_split(spark, d).select("doc_id", "text", "lang", "source", "n_chars", "split")
    schema = docs.drop("split").schema
    base = io.scratch_path(spark, "splits")
    files = {"train": (f"{base}/train", "parquet"), "validation": (f"{base}/validation", "json"),
             "test": (f"{base}/test", "csv")}
    for split, (path, fmt) in files.items():
        part = docs.where(F.col("split") == split).drop("split")
        if fmt == "csv":
            part.write.mode("overwrite").options(header="true", escape='"').csv(path)
        else:
            part.write.mode("overwrite").format(fmt).save(path)
    return io.read_splits(spark, files, schema)


@query("append_run_log")
def q_append_run_log(spark, d):
    """Two runs, the first of them tried twice."""
    docs = tb.documents_split(spark, d)
    path = io.scratch_path(spark, "runlog")
    for run, col in (("run1", "doc_id"), ("run2", "doc_id"), ("run1", "n_chars")):
        m = docs.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("samples"),
                                      F.avg(col).alias("mean_value"))
        long_ = m.select(F.lit(run).alias("run_id"), "split", F.inline(F.array(
            F.struct(F.lit("samples").alias("metric"), F.col("samples").alias("value")),
            F.struct(F.lit("mean_value").alias("metric"), F.col("mean_value").alias("value")))))
        io.append_run_log(long_, path)
    return io.read_run_log(spark, path).withColumn("value", tx.r6(F.col("value")))


# --- projections ----------------------------------------------------------------

@query("select_pair_columns")
def q_select_pair_columns(spark, d):
    return pr.select_pair_columns(tb.pairs_conv_with_transcript(spark, d), with_transcript=True)


@query("optional_transcript")
def q_optional_transcript(spark, d):
    p = tb.pairs_conv_with_transcript(spark, d)
    k = F.col("pair_id") % 3
    p = p.withColumn("transcript", F.when(k == 0, F.lit(None).cast("string"))
                     .when(k == 1, F.lit("")).otherwise(F.col("transcript")))
    o = pr.optional_transcript(p)
    return o.select("pair_id", "has_transcript",
                    F.coalesce(F.length("transcript"), F.lit(-1)).alias("transcript_chars"))


@query("drop_incomplete_pairs")
def q_drop_incomplete_pairs(spark, d):
    p = tb.pairs_conv(spark, d)
    k = F.col("pair_id") % 7
    p = p.withColumn("gold", F.when(k == 0, F.lit(None).cast("string")).otherwise(F.col("gold"))) \
         .withColumn("predicted", F.when(k == 3, F.lit("")).otherwise(F.col("predicted")))
    return pr.drop_incomplete_pairs(p).select("pair_id", "gold", "predicted")


@query("strip_text")
def q_strip_text(spark, d):
    p = tb.pairs_conv(spark, d).select("pair_id", F.concat(F.lit("  \n"), "gold", F.lit(" \t")).alias("gold"),
                                       "predicted")
    return pr.strip_pair_texts(p).select("pair_id", "gold", "predicted")


@query("split_sentences_naive")
def q_split_sentences_naive(spark, d):
    s = pr.split_sentences(tb.pairs_conv(spark, d), "predicted")
    return s.select("pair_id", F.size("sentences").alias("n_sentences"),
                    F.get("sentences", 0).alias("first_sentence"),
                    (F.col("rejoined") == F.col("predicted")).alias("identity"))


@query("sentence_lines")
def q_sentence_lines(spark, d):
    s = pr.sentence_lines(tb.pairs_conv(spark, d))
    return s.select("pair_id", "gold", "predicted", tx.line_count(F.col("predicted")).alias("pred_breaks"))


@query("build_vocab")
def q_build_vocab(spark, d):
    return conv_vocab(spark, d)


@query("encode_truncate_pad")
def q_encode_truncate_pad(spark, d):
    return conv_encoded(spark, d).select("pair_id", ids_str("input_ids"), ids_str("labels"))


@query("attention_masks")
def q_attention_masks(spark, d):
    m = tk.attention_masks(conv_encoded(spark, d))
    return m.select("pair_id", ids_str("attention_mask"), ids_str("global_attention_mask"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("tokens"))


@query("mask_labels")
def q_mask_labels(spark, d):
    m = tk.mask_labels(conv_encoded(spark, d))
    u = tk.unmask_labels(m.withColumnRenamed("labels", "restored"), "restored")
    return m.join(u.select("pair_id", "restored"), "pair_id").select(
        "pair_id", ids_str("labels"), ids_str("restored"))


@query("decode_ids")
def q_decode_ids(spark, d):
    vocab = conv_vocab(spark, d)
    e = tk.encode(tb.pairs_conv(spark, d), "pair_id", "gold", vocab)
    return tk.decode_ids(e, vocab, "pair_id", "ids", "decoded")


@query("flatten_scores")
def q_flatten_scores(spark, d):
    p = tb.pairs_conv(spark, d)
    r = overlap.rouge_n(p)
    b = overlap.bleu(p)
    nested = r.select("pair_id", F.struct(*[c for c in r.columns if c != "pair_id"]).alias("rouge")) \
        .join(b.select("pair_id", F.struct("bleu", "brevity_penalty").alias("bleu_s")), "pair_id")
    return pr.flatten_scores(nested)


@query("scale_round")
def q_scale_round(spark, d):
    r = overlap.rouge_n(tb.pairs_conv(spark, d))
    return pr.scale_round(r, [c for c in r.columns if c != "pair_id"])


@query("prune_columns")
def q_prune_columns(spark, d):
    m = tk.mask_labels(tk.attention_masks(conv_encoded(spark, d)))
    return m.select("pair_id", ids_str("input_ids"), ids_str("attention_mask"),
                    ids_str("global_attention_mask"), ids_str("labels"))


@query("add_prefix")
def q_add_prefix(spark, d):
    return pr.add_prefix(tb.pairs_conv(spark, d), "summarize: ", "gold").select("pair_id", "gold")


# --- joins, sets, limits, aggregates over pairs -----------------------------------

@query("align_pairs")
def q_align_pairs(spark, d):
    p = tb.pairs_conv(spark, d)
    return pr.align_pairs(p.select("pair_id", "gold"), p.select("pair_id", "predicted"))


@query("check_alignment")
def q_check_alignment(spark, d):
    p = tb.pairs_conv(spark, d)
    g = p.where(F.col("pair_id") % 7 != 0).select("pair_id", "gold")
    h = p.where(F.col("pair_id") % 7 != 3).select("pair_id", "predicted")
    return pr.check_alignment(g, h)


@query("combine_metrics")
def q_combine_metrics(spark, d):
    p = tb.pairs_conv(spark, d)
    r = overlap.rouge_n(p)
    b = overlap.bleu(p).select("pair_id", "bleu", "brevity_penalty")
    return pr.combine_metrics([r, b])


@query("gen_len")
def q_gen_len(spark, d):
    e = tk.encode(tb.pairs_conv(spark, d), "pair_id", "predicted", conv_vocab(spark, d))
    return tk.gen_len(e, "ids").select(tx.r6(F.col("gen_len")).alias("gen_len"))


@query("corpus_mean")
def q_corpus_mean(spark, d):
    return ag.corpus_mean(overlap.rouge_n(tb.pairs_conv(spark, d), places=None), ["rouge1_f", "rouge2_f"])


@query("multi_reference_mean")
def q_multi_reference_mean(spark, d):
    """Each assistant turn against two references: the user turn before it
    and the next user turn (when there is one)."""
    c = tb.table(spark, d, "conversations")
    p = tb.pairs_conv(spark, d)
    nxt = c.where(F.col("role") == "user").select(
        F.col("conv_id").alias("n_conv"), F.col("turn").alias("n_turn"), F.col("text").alias("ref2"))
    j = p.join(nxt, (p.conv_id == nxt.n_conv) & (nxt.n_turn == (p.pair_id % tb.PAIR_TURNS) + 2), "left")
    refs = j.select("pair_id", "predicted", F.inline(F.array(
        F.struct(F.lit(0).alias("ref_no"), F.col("gold").alias("ref")),
        F.struct(F.lit(1).alias("ref_no"), F.col("ref2").alias("ref"))))).where(F.col("ref").isNotNull())
    refs = refs.select((F.col("pair_id") * 2 + F.col("ref_no")).alias("ref_key"),
                       F.col("ref").alias("gold"), "predicted")
    s = overlap.rouge_n(refs, ns=(1,), key="ref_key", places=None)
    s = s.withColumn("pair_id", F.shiftright("ref_key", 1))
    return ag.multi_reference_mean(s, "pair_id", ["rouge1_f"])


@query("preview")
def q_preview(spark, d):
    return pr.preview(overlap.rouge_n(tb.pairs_conv(spark, d)), PREVIEW_N)


# --- documents ------------------------------------------------------------------

@query("cap_samples")
def q_cap_samples(spark, d):
    return pr.cap_samples(tb.documents_split(spark, d), CAP_N, "split", "doc_id").select(
        "doc_id", "split")


@query("sample_counts")
def q_sample_counts(spark, d):
    return ag.sample_counts(tb.documents_split(spark, d), MAX_SAMPLES)


@query("idf_table")
def q_idf_table(spark, d):
    return ag.idf_table(tb.table(spark, d, "documents"), "doc_id", "text")


@query("lm_perplexity")
def q_lm_perplexity(spark, d):
    docs = tb.table(spark, d, "documents")
    return lm.lm_perplexity(docs, docs, "doc_id", "text")


@query("require_splits")
def q_require_splits(spark, d):
    return dq.require_splits(tb.documents_split(spark, d), REQUIRED_SPLITS)


@query("repeat_ngram_rate")
def q_repeat_ngram_rate(spark, d):
    return dq.repeat_ngram_rate(tb.table(spark, d, "documents"), "doc_id", "text")


@query("length_bounds")
def q_length_bounds(spark, d):
    return dq.length_bounds(tb.table(spark, d, "documents"), "text", "source")


# --- conversations ----------------------------------------------------------------

@query("assemble_transcript")
def q_assemble_transcript(spark, d):
    return tb.transcripts(spark, d)


@query("turn_challenges")
def q_turn_challenges(spark, d):
    return an.turn_challenges(tb.table(spark, d, "conversations"))


# --- labelled documents: systems and analysis ----------------------------------------

@query("union_systems")
def q_union_systems(spark, d):
    s = doc_scores(spark, d, ("rouge1_f",))
    frames = {"arch_A": s.where(F.col("arch") == "A").drop("system"),
              "arch_B": s.where(F.col("arch") == "B").drop("system")}
    return pr.union_systems(frames).select("pair_id", "system", "rouge1_f")


@query("mean_scores")
def q_mean_scores(spark, d):
    return ag.mean_scores(doc_scores(spark, d).drop("arch"), "system")


@query("leaderboard")
def q_leaderboard(spark, d):
    return ag.leaderboard(doc_scores(spark, d, ("rouge1_f",)), "rouge1_f", "system")


@query("join_annotations")
def q_join_annotations(spark, d):
    s = doc_scores(spark, d, ("rouge1_f", "perplexity")).select("pair_id", "rouge1_f", "perplexity")
    return pr.join_annotations(s, tb.ann_doc(spark, d))


@query("metric_error_correlation")
def q_metric_error_correlation(spark, d):
    return doc_correlations(spark, d)


@query("metric_impact_correlation")
def q_metric_impact_correlation(spark, d):
    return an.metric_impact_correlation(doc_scores(spark, d), tb.ann_doc(spark, d), ANALYSIS_METRICS)


@query("challenge_error_link")
def q_challenge_error_link(spark, d):
    return an.challenge_error_link(tb.chal_doc(spark, d), tb.ann_doc(spark, d), tb.pairs_doc(spark, d))


@query("error_masking_flags")
def q_error_masking_flags(spark, d):
    return an.error_masking_flags(doc_correlations(spark, d), ORIENTATION)


@query("strength_labels")
def q_strength_labels(spark, d):
    return an.strength_labels(doc_correlations(spark, d))


@query("composite_score")
def q_composite_score(spark, d):
    return an.composite_score(doc_scores(spark, d, tuple(COMPOSITE_WEIGHTS)), COMPOSITE_WEIGHTS)


@query("error_rates_by_system")
def q_error_rates_by_system(spark, d):
    return an.error_rates_by_system(tb.ann_doc(spark, d), tb.pairs_doc(spark, d), ERROR_TYPES)


# --- character and alignment metrics ------------------------------------------------

from quillmark.operators.metrics import chrf as chrf_m  # noqa: E402
from quillmark.operators.metrics import meteor as meteor_m  # noqa: E402


@query("chrf")
def q_chrf(spark, d):
    return chrf_m.chrf(tb.pairs_conv(spark, d))


@query("chrf_lead")
def q_chrf_lead(spark, d):
    return chrf_m.chrf(tb.pairs_lead(spark, d))


@query("meteor")
def q_meteor(spark, d):
    return meteor_m.meteor(tb.pairs_conv(spark, d))


@query("meteor_lead")
def q_meteor_lead(spark, d):
    return meteor_m.meteor(tb.pairs_lead(spark, d))


# --- coverage and cloze --------------------------------------------------------------

from quillmark.operators.metrics import cloze as cloze_m  # noqa: E402
from quillmark.operators.metrics import coverage as cov_m  # noqa: E402


@query("answer_coverage")
def q_answer_coverage(spark, d):
    return cov_m.answer_coverage(tb.pairs_conv(spark, d), tb.table(spark, d, "documents"),
                                 tb.transcripts(spark, d))


@query("answer_coverage_lead")
def q_answer_coverage_lead(spark, d):
    return cov_m.answer_coverage(tb.pairs_lead(spark, d), tb.table(spark, d, "documents"))


@query("cloze_gain_lead")
def q_cloze_gain_lead(spark, d):
    return cloze_m.cloze_gain(tb.pairs_lead(spark, d), tb.table(spark, d, "documents"))


# --- vector metrics --------------------------------------------------------------------

from quillmark.operators.metrics import vectors as vec_m  # noqa: E402


def _vector_inputs(spark, d, pairs):
    vocab = tk.build_vocab(pairs, ["gold", "predicted"])
    vectors = tb.table(spark, d, "embeddings")
    return vec_m.token_vec_ids(vocab, vectors.agg(F.count(F.lit(1))).scalar()), vectors


@query("embedding_match")
def q_embedding_match(spark, d):
    p = tb.pairs_conv(spark, d)
    return vec_m.embedding_match(p, *_vector_inputs(spark, d, p))


@query("embedding_match_lead")
def q_embedding_match_lead(spark, d):
    p = tb.pairs_lead(spark, d)
    return vec_m.embedding_match(p, *_vector_inputs(spark, d, p))


@query("mover_score")
def q_mover_score(spark, d):
    p = tb.pairs_conv(spark, d)
    return vec_m.mover_score(p, *_vector_inputs(spark, d, p))


# --- LCS metrics, stemming (Arrow UDFs; rows-only checks plus brute-force unit tests) ----

from quillmark.operators.metrics import lcs as lcs_m  # noqa: E402


@query("rouge_l")
def q_rouge_l(spark, d):
    return lcs_m.rouge_l(tb.pairs_conv(spark, d))


@query("rouge_l_lead")
def q_rouge_l_lead(spark, d):
    return lcs_m.rouge_l(tb.pairs_lead(spark, d))


@query("rouge_lsum")
def q_rouge_lsum(spark, d):
    return lcs_m.rouge_lsum(tb.pairs_conv(spark, d))


@query("rouge_stemmed")
def q_rouge_stemmed(spark, d):
    return lcs_m.rouge_stemmed(tb.pairs_conv(spark, d))


@query("meteor_stem")
def q_meteor_stem(spark, d):
    return meteor_m.meteor(tb.pairs_conv(spark, d), stem_stage=True)


# --- model seams --------------------------------------------------------------------

from quillmark.operators import registry as rg  # noqa: E402
from quillmark.operators.metrics import learned as learned_m  # noqa: E402

LEARNED_FEATURES = ["rouge1_f", "perplexity", "repeat_rate", "n_tokens"]


def _labelled_scores(spark, d, metrics):
    lab = tb.table(spark, d, "labels").select(F.col("doc_id").alias("pair_id"), "quality")
    return doc_scores(spark, d, tuple(metrics)).join(lab, "pair_id")


@query("score_with")
def q_score_with(spark, d):
    return rg.score_with(tb.pairs_conv(spark, d), rg.make_length_ratio_scorer, rg.LENGTH_RATIO_SCHEMA)


@query("learned_score")
def q_learned_score(spark, d):
    return learned_m.learned_score(_labelled_scores(spark, d, LEARNED_FEATURES), LEARNED_FEATURES, "quality")


@query("learned_score_1f")
def q_learned_score_1f(spark, d):
    return learned_m.learned_score(_labelled_scores(spark, d, ["rouge1_f"]), ["rouge1_f"], "quality")


def _two_references(spark, d, p):
    """``pair_id, ref_id, gold``: the user turn before an assistant turn and the next one."""
    c = tb.table(spark, d, "conversations")
    nxt = c.where(F.col("role") == "user").select(
        F.col("conv_id").alias("n_conv"), F.col("turn").alias("n_turn"), F.col("text").alias("ref2"))
    j = p.join(nxt, (p.conv_id == nxt.n_conv) & (nxt.n_turn == (p.pair_id % tb.PAIR_TURNS) + 2), "left")
    return j.select("pair_id", F.inline(F.array(
        F.struct(F.lit(0).alias("ref_id"), F.col("gold").alias("gold")),
        F.struct(F.lit(1).alias("ref_id"), F.col("ref2").alias("gold"))))).where(F.col("gold").isNotNull())


@query("bleu_multi_ref")
def q_bleu_multi_ref(spark, d):
    """Each assistant turn against the user turn before it and the next user turn."""
    p = tb.pairs_conv(spark, d)
    refs = _two_references(spark, d, p)
    return overlap.bleu_multi_ref(p.select("pair_id", "predicted"), refs)


@query("mover_score_idf")
def q_mover_score_idf(spark, d):
    """Tokens weighed by idf, against the user turns before and after."""
    p = tb.pairs_conv(spark, d)
    return vec_m.mover_score_idf(p, _two_references(spark, d, p), *_vector_inputs(spark, d, p))


@query("unannotated_pairs")
def q_unannotated_pairs(spark, d):
    s = overlap.rouge_n(tb.pairs_lead(spark, d), ns=(1,)).select("pair_id", "rouge1_f")
    return pr.unannotated_pairs(s, tb.ann_doc(spark, d))


@query("write_scores_by_system")
def q_write_scores_by_system(spark, d):
    p = tb.pairs_lead(spark, d)
    s = overlap.rouge_n(p, ns=(1,)).join(p.select("pair_id", "system"), "pair_id")
    path = io.scratch_path(spark, "scores-by-system")
    io.write_scores(s, path, partition_by="system")
    return io.read_scores(spark, path, s.schema)


# --- all metrics, evaluation of a run ----------------------------------------------------

from quillmark.operators import evaluation as ev  # noqa: E402
from quillmark.operators.metrics import combined as comb_m  # noqa: E402

N_SYSTEMS = 5


def pairs_by_system(spark, d):
    """Conversation pairs as the outputs of five systems."""
    return tb.pairs_conv(spark, d).withColumn(
        "system", F.concat(F.lit("s"), (F.col("conv_id") % N_SYSTEMS).cast("string")))


@query("all_metrics")
def q_all_metrics(spark, d):
    p = pairs_by_system(spark, d)
    vec_ids, vectors = _vector_inputs(spark, d, p)
    return comb_m.all_metrics(p, train=tb.table(spark, d, "documents"), vec_ids=vec_ids, embeddings=vectors)


def run_outputs(spark, d):
    """``(outputs, vocab)``: a run's predictions and labels as padded id arrays, labels masked."""
    vocab = conv_vocab(spark, d)
    e = tk.encode_columns(tb.pairs_conv(spark, d), "pair_id", vocab,
                          {"predictions": ("predicted", None), "labels": ("gold", None)})
    e = e.select("pair_id", *[tk.pad_to_multiple(F.col(c), MAX_SOURCE).alias(c) for c in ("predictions", "labels")])
    return tk.mask_labels(e), vocab


@query("evaluate_predictions")
def q_evaluate_predictions(spark, d):
    path = io.scratch_path(spark, "evaluation")
    ev.evaluate_predictions(*run_outputs(spark, d), path, run_id="run1", split="eval")
    return ev.read_evaluation(spark, path).drop("run_id", "split")


@query("evaluate_summary")
def q_evaluate_summary(spark, d):
    path = io.scratch_path(spark, "evaluation")
    return ev.evaluate_predictions(*run_outputs(spark, d), path, run_id="run1", split="eval")


@query("mean_perplexity")
def q_mean_perplexity(spark, d):
    docs = tb.table(spark, d, "documents")
    return lm.mean_perplexity(lm.lm_perplexity(docs, docs, "doc_id", "text"))


BATCH_ROWS = 64


@query("map_batches")
def q_map_batches(spark, d):
    """A function that depends on the batch: each prediction's length against its batch's mean."""
    def make():
        def centred(pdf):
            n = pdf["predicted"].str.len().astype("float64")
            return pdf[["pair_id"]].assign(batch_rows=len(pdf), centred=(n - n.mean()).round(6))
        return centred
    p = tb.pairs_conv(spark, d).select("pair_id", "predicted")
    return rg.map_batches(p, make, BATCH_ROWS, "pair_id long, batch_rows long, centred double", order=["pair_id"])
