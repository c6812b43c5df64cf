"""DuckDB oracle SQL, one string per registered query name.

Each string is self-contained (fixtures inlined as CTEs) and uses the same
column names as the Spark query.
"""

from __future__ import annotations

from quillmark.plans import sqlparts as sp
from quillmark.plans import sqlscores as sq
from quillmark.plans.sqlparts import f_measure, r6, safe_div, with_fixtures

ORACLE: dict[str, str] = {}


def _rouge_n(pairs: str) -> str:
    ns = (1, 2)
    ctes = sp.overlap_sql(pairs, sp.tok, ns)
    cols = []
    for n in ns:
        o = f"coalesce(ov.ov_{n}, 0)"
        p = f"({o} / greatest(len(t.h) - {n - 1}, 1))"
        r = f"({o} / greatest(len(t.g) - {n - 1}, 1))"
        cols += [f"{r6(p)} AS rouge{n}_p", f"{r6(r)} AS rouge{n}_r", f"{r6(f_measure(p, r))} AS rouge{n}_f"]
    return (with_fixtures([pairs], *ctes)
            + f"SELECT t.pair_id, {', '.join(cols)} FROM ov_t t LEFT JOIN ov ON t.pair_id = ov.pair_id")


ORACLE["rouge_n"] = _rouge_n("pairs_conv")
ORACLE["rouge_n_lead"] = _rouge_n("pairs_lead")


def _bleu_select(src: str, keep: list[str]) -> str:
    ps = {n: safe_div(f"m{n}", f"t{n}") for n in range(1, 5)}
    allpos = " AND ".join(f"{ps[n]} > 0" for n in range(1, 5))
    lnsum = " + ".join(f"ln(CASE WHEN {ps[n]} > 0 THEN {ps[n]} ELSE 1.0 END)" for n in range(1, 5))
    geo = f"(CASE WHEN {allpos} THEN exp(({lnsum}) / 4) ELSE 0.0 END)"
    ratio = safe_div("hyp_len", "ref_len")
    bp = (f"(CASE WHEN hyp_len = 0 THEN 0.0 WHEN {ratio} > 1 THEN 1.0 WHEN {ratio} = 0 THEN 0.0 "
          f"ELSE exp(1.0 - 1.0 / {ratio}) END)")
    cols = keep + [f"{r6(f'{geo} * {bp}')} AS bleu"] + [f"{r6(ps[n])} AS p{n}" for n in range(1, 5)] + [
        f"{r6(bp)} AS brevity_penalty", f"{r6(ratio)} AS length_ratio",
        "hyp_len AS translation_length", "ref_len AS reference_length"]
    return f"SELECT {', '.join(cols)} FROM {src}"


def _bleu_stats_ctes(pairs: str, extra: str = "") -> list[tuple[str, str]]:
    ctes = sp.overlap_sql(pairs, sp.tok13a, range(1, 5), name="bo")
    ex = f", p.{extra}" if extra else ""
    ms = ", ".join(f"CAST(coalesce(bo.ov_{n}, 0) AS BIGINT) AS m{n}" for n in range(1, 5))
    ts = ", ".join(f"CAST(greatest(len(t.h) - {n - 1}, 0) AS BIGINT) AS t{n}" for n in range(1, 5))
    ctes.append(("st", f"SELECT t.pair_id{ex}, CAST(len(t.h) AS BIGINT) AS hyp_len, "
                       f"CAST(len(t.g) AS BIGINT) AS ref_len, {ms}, {ts} "
                       f"FROM bo_t t LEFT JOIN bo ON t.pair_id = bo.pair_id"
                       + (f" JOIN {pairs} p ON p.pair_id = t.pair_id" if extra else "")))
    return ctes


def _bleu(pairs: str) -> str:
    return with_fixtures([pairs], *_bleu_stats_ctes(pairs)) + _bleu_select("st", ["pair_id"])


ORACLE["bleu"] = _bleu("pairs_conv")
ORACLE["bleu_lead"] = _bleu("pairs_lead")


def _bleu_corpus(pairs: str, by: str) -> str:
    cols = ["hyp_len", "ref_len"] + [f"m{n}" for n in range(1, 5)] + [f"t{n}" for n in range(1, 5)]
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cols)
    ctes = _bleu_stats_ctes(pairs, extra=by)
    ctes.append(("g", f"SELECT {by}, {sums} FROM st GROUP BY {by}"))
    return with_fixtures([pairs], *ctes) + _bleu_select("g", [by])


ORACLE["bleu_corpus"] = _bleu_corpus("pairs_conv", "conv_id")


# --- shared CTE builders --------------------------------------------------------

PAIRS_T = ("pairs_t", "SELECT p.pair_id, p.conv_id, p.gold, p.predicted, t.transcript "
                      "FROM pairs_conv p LEFT JOIN transcripts t ON p.conv_id = t.conv_id")


def strip(x: str) -> str:
    white = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace({x}, '^{white}+|{white}+$', '', 'g')"


def vocab_ctes(pairs: str = "pairs_conv") -> list[tuple[str, str]]:
    return [
        ("vtok", f"SELECT unnest({sp.tok('gold')}) AS token FROM {pairs} "
                 f"UNION ALL SELECT unnest({sp.tok('predicted')}) FROM {pairs}"),
        ("vcnt", "SELECT token, count(*) AS count FROM vtok GROUP BY token"),
        ("vocab", "SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 AS BIGINT) AS rank, "
                  "CAST(row_number() OVER (ORDER BY count DESC, token) + 1 AS BIGINT) AS id FROM vcnt"),
    ]


def ids_ctes(col: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_o", f"SELECT pair_id, unnest({sp.tok(col)}) AS token, "
                      f"generate_subscripts({sp.tok(col)}, 1) AS pos FROM pairs_conv"),
        (f"{name}_l", f"SELECT o.pair_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY o.pos) AS ids "
                      f"FROM {name}_o o LEFT JOIN vocab v ON o.token = v.token GROUP BY o.pair_id"),
        (name, f"SELECT p.pair_id, coalesce(l.ids, CAST([] AS INTEGER[])) AS ids FROM pairs_conv p "
               f"LEFT JOIN {name}_l l ON p.pair_id = l.pair_id"),
    ]


def encoded_ctes() -> list[tuple[str, str]]:
    return vocab_ctes() + ids_ctes("gold", "src_ids") + ids_ctes("predicted", "tgt_ids") + [
        ("enc", "SELECT s.pair_id, list_resize(s.ids, 64, 0) AS input_ids, list_resize(t.ids, 32, 0) AS labels "
                "FROM src_ids s JOIN tgt_ids t ON s.pair_id = t.pair_id")]


def ids_str(x: str, name: str) -> str:
    return f"array_to_string({x}, ',') AS {name}"


def bigram_occ(src: str, key: str, text: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_t", f"SELECT {key} AS k, {sp.tok(text)} AS t FROM {src}"),
        (f"{name}_i", f"SELECT k, t, unnest(range(1, len(t) + 1)) AS i FROM {name}_t"),
        (name, f"SELECT k, CASE WHEN i = 1 THEN '<s>' ELSE t[i - 1] END AS v, t[i] AS w FROM {name}_i"),
    ]


def perplexity_ctes(src: str, key: str, text: str) -> list[tuple[str, str]]:
    """CTE ``ppl(k, n_tokens, perplexity)`` scoring ``src.text``, model from documents."""
    return bigram_occ("documents", "doc_id", "text", "tr") + bigram_occ(src, key, text, "sc") + [
        ("pc", "SELECT v, w, count(*) AS c_vw FROM tr GROUP BY v, w"),
        ("vc", "SELECT v, sum(c_vw) AS c_v FROM pc GROUP BY v"),
        ("vv", "SELECT CAST(count(DISTINCT w) AS DOUBLE) + 1.0 AS vsize FROM pc"),
        ("occ", "SELECT k, v, w, count(*) AS kk FROM sc GROUP BY k, v, w"),
        ("per", "SELECT o.k, sum(kk) AS n, sum(kk * ln((CAST(coalesce(pc.c_vw, 0) AS DOUBLE) + CAST(0.1 AS DOUBLE)) / "
                "(CAST(coalesce(vc.c_v, 0) AS DOUBLE) + CAST(0.1 AS DOUBLE) * vv.vsize))) AS s "
                "FROM occ o LEFT JOIN pc ON o.v = pc.v AND o.w = pc.w LEFT JOIN vc ON o.v = vc.v, vv GROUP BY o.k"),
        ("ppl", f"SELECT s.{key} AS k, CAST(coalesce(per.n, 0) AS BIGINT) AS n_tokens, "
                f"round(exp(-per.s / per.n), 4) AS perplexity FROM {src} s LEFT JOIN per ON s.{key} = per.k"),
    ]


def repeat_rate_ctes(src: str, key: str, text: str, name: str) -> list[tuple[str, str]]:
    """CTE ``name(k, ngrams, repeat_rate)``. The token list is materialised
    first: inside the n-gram lambda an inlined tokeniser would be re-run per
    element."""
    g = sp.ngrams("t", 3)
    return [(f"{name}_t!", f"SELECT {key} AS k, {sp.tok(text)} AS t FROM {src}"),
            (name, f"SELECT k, CAST(len(g) AS BIGINT) AS ngrams, "
                   f"round(CASE WHEN len(g) > 0 THEN 1.0 - len(list_distinct(g)) / len(g) END, 6) AS repeat_rate "
                   f"FROM (SELECT k, {g} AS g FROM {name}_t)")]


def doc_scores_ctes() -> list[tuple[str, str]]:
    rouge = sp.overlap_sql("pairs_doc", sp.tok, (1,), name="dr")
    p = "(dr.ov_1 / greatest(len(t.h), 1))"
    r = "(dr.ov_1 / greatest(len(t.g), 1))"
    return rouge + perplexity_ctes("pairs_doc", "pair_id", "predicted") + [
        *repeat_rate_ctes("pairs_doc", "pair_id", "predicted", "rr"),
        ("ds", f"SELECT d.pair_id, d.system, d.arch, {r6(f_measure(p, r))} AS rouge1_f, ppl.perplexity, "
               f"rr.repeat_rate, ppl.n_tokens FROM pairs_doc d "
               f"JOIN dr_t t ON d.pair_id = t.pair_id JOIN dr ON d.pair_id = dr.pair_id "
               f"JOIN ppl ON d.pair_id = ppl.k JOIN rr ON d.pair_id = rr.k")]


DOC_METRICS = ["rouge1_f", "perplexity", "repeat_rate", "n_tokens"]


def corr_ctes(yname: str) -> list[tuple[str, str]]:
    """CTE ``corr(metric, error_type, n, pearson, spearman)`` over ``ds`` x ``ann_doc``."""
    unions = " UNION ALL ".join(
        f"SELECT pair_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ds WHERE {m} IS NOT NULL"
        for m in DOC_METRICS)
    return doc_scores_ctes() + [
        ("lng", unions),
        ("obs", f"SELECT l.metric, a.error_type, l.value AS x, CAST(a.{yname} AS DOUBLE) AS y "
                f"FROM lng l JOIN ann_doc a ON l.pair_id = a.pair_id"),
        ("rk", "SELECT metric, error_type, x, y, "
               "rank() OVER (PARTITION BY metric, error_type ORDER BY x) "
               "+ (count(*) OVER (PARTITION BY metric, error_type, x) - 1) / 2.0 AS rx, "
               "rank() OVER (PARTITION BY metric, error_type ORDER BY y) "
               "+ (count(*) OVER (PARTITION BY metric, error_type, y) - 1) / 2.0 AS ry FROM obs"),
        ("corr", "SELECT metric, error_type, count(*) AS n, "
                 "round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson, "
                 "round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman "
                 "FROM rk GROUP BY metric, error_type"),
    ]


DOC_FIX = ["pairs_doc", "ann_doc"]


# --- sources and sinks ------------------------------------------------------------

ORACLE["read_pairs"] = (with_fixtures(["pairs_conv", "transcripts"], PAIRS_T)
                        + "SELECT pair_id, gold, predicted, transcript FROM pairs_t")
ORACLE["select_pair_columns"] = ORACLE["read_pairs"]
ORACLE["write_scores"] = ORACLE["rouge_n"]

ORACLE["write_run_results"] = (
    with_fixtures(["pairs_conv"], *sp.overlap_sql("pairs_conv", sp.tok, (1, 2))) + f"""
SELECT p.pair_id, p.predicted AS prediction, p.gold AS label,
  round({r6(f_measure('(coalesce(ov.ov_1,0) / greatest(len(t.h), 1))', '(coalesce(ov.ov_1,0) / greatest(len(t.g), 1))'))} * 100, 4) AS rouge1_f,
  round({r6(f_measure('(coalesce(ov.ov_2,0) / greatest(len(t.h) - 1, 1))', '(coalesce(ov.ov_2,0) / greatest(len(t.g) - 1, 1))'))} * 100, 4) AS rouge2_f,
  'run1' AS run_id, CASE WHEN p.pair_id % 2 = 0 THEN 'eval' ELSE 'test' END AS split
FROM pairs_conv p JOIN ov_t t ON p.pair_id = t.pair_id LEFT JOIN ov ON p.pair_id = ov.pair_id""")

ORACLE["write_predictions_text"] = (
    with_fixtures(["pairs_conv"])
    + f"SELECT pair_id, regexp_replace({strip('predicted')}, '[\r\n]', ' ', 'g') AS predicted FROM pairs_conv")

ORACLE["read_splits"] = with_fixtures(["docs_split"]) + "SELECT doc_id, text, lang, source, n_chars, split FROM docs_split"

ORACLE["append_run_log"] = with_fixtures(["docs_split"]) + """
SELECT run_id, split, metric, round(value, 6) AS value FROM (
  SELECT 'run1' AS run_id, split, 'samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM docs_split GROUP BY split
  UNION ALL SELECT 'run1', split, 'mean_value', avg(n_chars) FROM docs_split GROUP BY split
  UNION ALL SELECT 'run2', split, 'samples', CAST(count(*) AS DOUBLE) FROM docs_split GROUP BY split
  UNION ALL SELECT 'run2', split, 'mean_value', avg(doc_id) FROM docs_split GROUP BY split)"""

# --- projections --------------------------------------------------------------------

ORACLE["optional_transcript"] = with_fixtures(["pairs_conv", "transcripts"], PAIRS_T) + """
SELECT pair_id, (tr IS NOT NULL AND length(tr) > 0) AS has_transcript, coalesce(length(tr), -1) AS transcript_chars
FROM (SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN NULL WHEN pair_id % 3 = 1 THEN '' ELSE transcript END AS tr
      FROM pairs_t)"""

ORACLE["drop_incomplete_pairs"] = with_fixtures(["pairs_conv"]) + """
SELECT pair_id, gold, predicted FROM (
  SELECT pair_id, CASE WHEN pair_id % 7 = 0 THEN NULL ELSE gold END AS gold,
         CASE WHEN pair_id % 7 = 3 THEN '' ELSE predicted END AS predicted FROM pairs_conv)
WHERE gold IS NOT NULL AND gold <> '' AND predicted IS NOT NULL AND predicted <> ''"""

ORACLE["strip_text"] = (with_fixtures(["pairs_conv"])
                        + f"SELECT pair_id, {strip(chr(39) + '  ' + chr(39) + ' || chr(10) || gold || ' + chr(39) + ' ' + chr(39) + ' || chr(9)')} AS gold, "
                        + f"{strip('predicted')} AS predicted FROM pairs_conv")

ORACLE["split_sentences_naive"] = with_fixtures(["pairs_conv"]) + """
SELECT pair_id, CAST(len(string_split(predicted, '. ')) AS INTEGER) AS n_sentences,
       string_split(predicted, '. ')[1] AS first_sentence,
       array_to_string(string_split(predicted, '. '), '. ') = predicted AS identity FROM pairs_conv"""

_SL = r"regexp_replace({x}, '([.!?])\s+', '\1' || chr(10), 'g')"
ORACLE["sentence_lines"] = with_fixtures(["pairs_conv"]) + (
    f"SELECT pair_id, {_SL.format(x='gold')} AS gold, {_SL.format(x='predicted')} AS predicted, "
    f"CAST(length({_SL.format(x='predicted')}) - length(replace({_SL.format(x='predicted')}, chr(10), '')) AS INTEGER) "
    f"AS pred_breaks FROM pairs_conv")

ORACLE["build_vocab"] = with_fixtures(["pairs_conv"], *vocab_ctes()) + "SELECT token, count, rank, id FROM vocab"

ORACLE["encode_truncate_pad"] = with_fixtures(["pairs_conv"], *encoded_ctes()) + (
    f"SELECT pair_id, {ids_str('input_ids', 'input_ids')}, {ids_str('labels', 'labels')} FROM enc")

_AM = "list_transform(input_ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)"
_GM = "list_transform(input_ids, lambda x, i: CASE WHEN i = 1 THEN 1 ELSE 0 END)"
_ML = "list_transform(labels, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)"
ORACLE["attention_masks"] = with_fixtures(["pairs_conv"], *encoded_ctes()) + (
    f"SELECT pair_id, {ids_str(_AM, 'attention_mask')}, {ids_str(_GM, 'global_attention_mask')}, "
    f"CAST(list_sum({_AM}) AS INTEGER) AS tokens FROM enc")

ORACLE["mask_labels"] = with_fixtures(["pairs_conv"], *encoded_ctes()) + (
    f"SELECT pair_id, {ids_str(_ML, 'labels')}, "
    f"{ids_str('list_transform(' + _ML + ', lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)', 'restored')} FROM enc")

ORACLE["prune_columns"] = with_fixtures(["pairs_conv"], *encoded_ctes()) + (
    f"SELECT pair_id, {ids_str('input_ids', 'input_ids')}, {ids_str(_AM, 'attention_mask')}, "
    f"{ids_str(_GM, 'global_attention_mask')}, {ids_str(_ML, 'labels')} FROM enc")

ORACLE["decode_ids"] = with_fixtures(["pairs_conv"]) + (
    f"SELECT pair_id, array_to_string({sp.tok('gold')}, ' ') AS decoded FROM pairs_conv")


def _rouge_cols(alias_t: str = "t", alias_o: str = "ov") -> str:
    cols = []
    for n in (1, 2):
        o = f"coalesce({alias_o}.ov_{n}, 0)"
        p = f"({o} / greatest(len({alias_t}.h) - {n - 1}, 1))"
        r = f"({o} / greatest(len({alias_t}.g) - {n - 1}, 1))"
        cols += [f"{r6(p)} AS rouge{n}_p", f"{r6(r)} AS rouge{n}_r", f"{r6(f_measure(p, r))} AS rouge{n}_f"]
    return ", ".join(cols)


_ROUGE_CONV = ("rouge", f"SELECT t.pair_id, {_rouge_cols()} FROM ov_t t LEFT JOIN ov ON t.pair_id = ov.pair_id")
_BLEU_CONV = ("bleu_s", _bleu_select("st", ["pair_id"]))
_RB = sp.overlap_sql("pairs_conv", sp.tok, (1, 2)) + [_ROUGE_CONV] + _bleu_stats_ctes("pairs_conv") + [_BLEU_CONV]

ORACLE["flatten_scores"] = with_fixtures(["pairs_conv"], *_RB) + (
    "SELECT r.*, b.bleu, b.brevity_penalty FROM rouge r JOIN bleu_s b ON r.pair_id = b.pair_id")
ORACLE["combine_metrics"] = ORACLE["flatten_scores"]

ORACLE["scale_round"] = with_fixtures(["pairs_conv"], *sp.overlap_sql("pairs_conv", sp.tok, (1, 2)), _ROUGE_CONV) + (
    "SELECT pair_id, " + ", ".join(f"round({c} * 100, 4) AS {c}" for n in (1, 2) for c in
                                   (f"rouge{n}_p", f"rouge{n}_r", f"rouge{n}_f")) + " FROM rouge")

ORACLE["add_prefix"] = with_fixtures(["pairs_conv"]) + "SELECT pair_id, 'summarize: ' || gold AS gold FROM pairs_conv"

# --- joins, sets, limits, aggregates over pairs -------------------------------------------

ORACLE["align_pairs"] = with_fixtures(["pairs_conv"]) + "SELECT pair_id, gold, predicted FROM pairs_conv"

ORACLE["check_alignment"] = with_fixtures(["pairs_conv"]) + """
SELECT pair_id, CASE WHEN pair_id % 7 = 0 THEN 'predicted' ELSE 'gold' END AS only_in
FROM pairs_conv WHERE pair_id % 7 IN (0, 3)"""

ORACLE["gen_len"] = with_fixtures(["pairs_conv"]) + (
    f"SELECT round(avg(len({sp.tok('predicted')})), 6) AS gen_len FROM pairs_conv")

_ROUGE_RAW = ("rouge", "SELECT t.pair_id, " + ", ".join(
    f"{f_measure(f'(coalesce(ov.ov_{n}, 0) / greatest(len(t.h) - {n - 1}, 1))', f'(coalesce(ov.ov_{n}, 0) / greatest(len(t.g) - {n - 1}, 1))')} AS rouge{n}_f"
    for n in (1, 2)) + " FROM ov_t t LEFT JOIN ov ON t.pair_id = ov.pair_id")
ORACLE["corpus_mean"] = with_fixtures(["pairs_conv"], *sp.overlap_sql("pairs_conv", sp.tok, (1, 2)), _ROUGE_RAW) + (
    "SELECT count(*) AS pairs, round(avg(rouge1_f), 6) AS corpus_rouge1_f, "
    "round(avg(rouge2_f), 6) AS corpus_rouge2_f FROM rouge")

_MR_REFS = ("refs", """
SELECT p.pair_id * 2 AS pair_id, p.gold, p.predicted FROM pairs_conv p
UNION ALL
SELECT p.pair_id * 2 + 1, n.text, p.predicted FROM pairs_conv p
JOIN conversations n ON n.conv_id = p.conv_id AND n.turn = p.pair_id % 4294967296 + 2 AND n.role = 'user'""")
_MR = sp.overlap_sql("refs", sp.tok, (1,), name="mr")
ORACLE["multi_reference_mean"] = with_fixtures(["pairs_conv"], _MR_REFS, *_MR) + f"""
SELECT pair_id, count(*) AS references, round(avg(f), 6) AS mean_rouge1_f FROM (
  SELECT t.pair_id // 2 AS pair_id,
         {f_measure('(coalesce(mr.ov_1,0) / greatest(len(t.h), 1))', '(coalesce(mr.ov_1,0) / greatest(len(t.g), 1))')} AS f
  FROM mr_t t LEFT JOIN mr ON t.pair_id = mr.pair_id) GROUP BY pair_id"""

ORACLE["preview"] = ORACLE["rouge_n"] + " ORDER BY t.pair_id LIMIT 20"

# --- documents --------------------------------------------------------------------------

ORACLE["cap_samples"] = with_fixtures(["docs_split"]) + """
SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn
FROM docs_split) WHERE rn <= 50"""

ORACLE["sample_counts"] = with_fixtures(["docs_split"]) + (
    "SELECT split, least(count(*), CAST(500 AS BIGINT)) AS samples FROM docs_split GROUP BY split")

ORACLE["idf_table"] = f"""
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
t AS (SELECT unnest(list_distinct({sp.tok('text')})) AS token FROM documents),
g AS (SELECT token, count(*) AS df FROM t GROUP BY token)
SELECT token, df, round(ln((n.n + 1.0) / (df + 1.0)), 6) AS idf FROM g, n"""

ORACLE["lm_perplexity"] = (with_fixtures([], *perplexity_ctes("documents", "doc_id", "text"))
                           
                           + "SELECT k AS doc_id, n_tokens, perplexity FROM ppl")

ORACLE["require_splits"] = with_fixtures(["docs_split"]) + """
SELECT split FROM (VALUES ('train'), ('validation'), ('test'), ('holdout')) r(split)
WHERE split NOT IN (SELECT DISTINCT split FROM docs_split)"""

ORACLE["repeat_ngram_rate"] = (with_fixtures([], *repeat_rate_ctes("documents", "doc_id", "text", "rr"))
                               + " SELECT k AS doc_id, ngrams, repeat_rate FROM rr")

_NT = f"len({sp.tok('text')})"
ORACLE["length_bounds"] = f"""
SELECT source, count(*) AS n,
  CAST(sum(CASE WHEN {_NT} BETWEEN 100 AND 1024 THEN 1 ELSE 0 END) AS BIGINT) AS within,
  CAST(sum(CASE WHEN {_NT} < 100 THEN 1 ELSE 0 END) AS BIGINT) AS too_short,
  CAST(sum(CASE WHEN {_NT} > 1024 THEN 1 ELSE 0 END) AS BIGINT) AS too_long
FROM documents GROUP BY source"""

# --- conversations ------------------------------------------------------------------------

ORACLE["assemble_transcript"] = with_fixtures(["transcripts"]) + "SELECT conv_id, transcript FROM transcripts"

ORACLE["turn_challenges"] = f"""
WITH t AS (SELECT conv_id, turn, role, len({sp.tok('text')}) AS ntok,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM conversations)
SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS speakers,
  CAST(sum(CASE WHEN prev_role IS NOT NULL AND prev_role <> role THEN 1 ELSE 0 END) AS BIGINT) AS switches,
  round(avg(ntok), 6) AS mean_tokens_per_turn FROM t GROUP BY conv_id"""

# --- labelled documents: systems and analysis -----------------------------------------------

_DS = doc_scores_ctes()

ORACLE["union_systems"] = with_fixtures(["pairs_doc"], *_DS) + (
    "SELECT pair_id, 'arch_' || arch AS system, rouge1_f FROM ds")

ORACLE["mean_scores"] = with_fixtures(["pairs_doc"], *_DS) + (
    "SELECT system, " + ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in DOC_METRICS)
    + " FROM ds GROUP BY system")

ORACLE["leaderboard"] = with_fixtures(["pairs_doc"], *_DS) + """
SELECT system, mean, std, n, rank() OVER (ORDER BY mean DESC) AS rank FROM (
  SELECT system, round(avg(rouge1_f), 6) AS mean, round(stddev_samp(rouge1_f), 6) AS std, count(*) AS n
  FROM ds GROUP BY system)"""

ORACLE["join_annotations"] = with_fixtures(DOC_FIX, *_DS) + """
SELECT d.pair_id, d.rouge1_f, d.perplexity, a.error_type, a.present, a.severity
FROM ds d JOIN ann_doc a ON d.pair_id = a.pair_id"""

ORACLE["metric_error_correlation"] = with_fixtures(DOC_FIX, *corr_ctes("present")) + "SELECT * FROM corr"
ORACLE["metric_impact_correlation"] = with_fixtures(DOC_FIX, *corr_ctes("severity")) + "SELECT * FROM corr"

ORACLE["error_masking_flags"] = with_fixtures(DOC_FIX, *corr_ctes("present")) + """
SELECT metric, error_type, pearson, round(pearson * o, 6) AS oriented_r, pearson * o > -0.1 AS masked FROM (
  SELECT *, CASE WHEN metric IN ('perplexity', 'repeat_rate') THEN -1 ELSE 1 END AS o FROM corr)"""


def _strength(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN abs({c}) < 0.1 THEN 'negligible' WHEN abs({c}) < 0.3 THEN 'weak' "
            f"WHEN abs({c}) < 0.5 THEN 'moderate' ELSE 'strong' END AS {c}_strength")


ORACLE["strength_labels"] = with_fixtures(DOC_FIX, *corr_ctes("present")) + (
    f"SELECT metric, error_type, pearson, spearman, {_strength('pearson')}, {_strength('spearman')} FROM corr")

ORACLE["challenge_error_link"] = with_fixtures(["pairs_doc", "ann_doc", "chal_doc"]) + """
SELECT arch, challenge, error_type, n, n_chal, n_err, n_both,
  round(CASE WHEN n_chal > 0 THEN n_both / n_chal END, 6) AS p_err_given_chal,
  round(CASE WHEN n > 0 THEN n_err / n END, 6) AS base_rate,
  round(CASE WHEN n_chal > 0 AND n_err > 0 THEN (n_both / n_chal) / (n_err / n) END, 6) AS lift,
  round(CASE WHEN n_chal * (n - n_chal) * n_err * (n - n_err) > 0 THEN
     (n_both * (n - n_chal - n_err + n_both) - (n_chal - n_both) * (n_err - n_both))
     / sqrt(n_chal * (n - n_chal) * n_err * (n - n_err)) END, 6) AS phi
FROM (
  SELECT p.arch, c.challenge, a.error_type, count(*) AS n, CAST(sum(c.present) AS BIGINT) AS n_chal,
         CAST(sum(a.present) AS BIGINT) AS n_err, CAST(sum(c.present * a.present) AS BIGINT) AS n_both
  FROM chal_doc c JOIN ann_doc a ON c.pair_id = a.pair_id JOIN pairs_doc p ON p.pair_id = c.pair_id
  GROUP BY p.arch, c.challenge, a.error_type)"""

_W = {"rouge1_f": 1.0, "perplexity": -1.0, "repeat_rate": -1.0}
ORACLE["composite_score"] = with_fixtures(["pairs_doc"], *_DS, (
    "st", "SELECT " + ", ".join(f"avg({m}) AS mu_{m}, stddev_pop({m}) AS sd_{m}" for m in _W) + " FROM ds")) + (
    "SELECT pair_id, round(" + " + ".join(
        f"CAST({w} AS DOUBLE) * (CASE WHEN sd_{m} > 0 THEN ({m} - mu_{m}) / sd_{m} ELSE 0.0 END)"
        for m, w in _W.items()) + ", 6) AS composite FROM ds, st")

ORACLE["error_rates_by_system"] = with_fixtures(["pairs_doc", "ann_doc"]) + """
SELECT p.system, p.arch,
  round(avg(CASE WHEN a.error_type = 'low_quality' THEN a.present END), 6) AS low_quality,
  round(avg(CASE WHEN a.error_type = 'toxic' THEN a.present END), 6) AS toxic
FROM ann_doc a JOIN pairs_doc p ON a.pair_id = p.pair_id GROUP BY p.system, p.arch"""


# --- chrF and METEOR ----------------------------------------------------------------


def chars(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '\s+', '', 'g'), ''), lambda t: t <> '')"


def _chrf(pairs: str) -> str:
    ns = range(1, 7)
    ctes = sp.overlap_sql(pairs, chars, ns, name="cf")
    eff = "least(len(t.g), len(t.h))"
    neff = f"least({eff}, 6)"
    psum = " + ".join(f"(CASE WHEN {eff} >= {n} THEN coalesce(cf.ov_{n}, 0) / (len(t.h) - {n - 1}) ELSE 0.0 END)" for n in ns)
    rsum = " + ".join(f"(CASE WHEN {eff} >= {n} THEN coalesce(cf.ov_{n}, 0) / (len(t.g) - {n - 1}) ELSE 0.0 END)" for n in ns)
    ctes.append(("pr", f"SELECT t.pair_id, {neff} AS ne, ({psum}) / greatest({neff}, 1) AS p, "
                       f"({rsum}) / greatest({neff}, 1) AS r FROM cf_t t LEFT JOIN cf ON t.pair_id = cf.pair_id"))
    return with_fixtures([pairs], *ctes) + (
        "SELECT pair_id, round(CASE WHEN ne = 0 OR p + r = 0 THEN 0.0 "
        "ELSE 100.0 * 5.0 * p * r / (4.0 * p + r) END, 6) AS chrf FROM pr")


ORACLE["chrf"] = _chrf("pairs_conv")


def token_occ_ctes(pairs: str, name: str = "mt") -> list[tuple[str, str]]:
    return [
        (f"{name}_t", f"SELECT pair_id, {sp.tok('gold')} AS g, {sp.tok('predicted')} AS h FROM {pairs}"),
        (f"{name}_o", f"SELECT pair_id, 0 AS side, unnest(g) AS token, generate_subscripts(g, 1) - 1 AS pos FROM {name}_t "
                      f"UNION ALL SELECT pair_id, 1, unnest(h), generate_subscripts(h, 1) - 1 FROM {name}_t"),
    ]


def _meteor(pairs: str) -> str:
    ctes = token_occ_ctes(pairs) + [
        ("mk", "SELECT *, row_number() OVER (PARTITION BY pair_id, side, token ORDER BY pos DESC) AS k FROM mt_o"),
        ("mm", "SELECT h.pair_id, h.pos AS hpos, g.pos AS gpos FROM mk h JOIN mk g ON h.pair_id = g.pair_id "
               "AND h.token = g.token AND h.k = g.k AND h.side = 1 AND g.side = 0"),
        ("mb", "SELECT pair_id, CASE WHEN hpos - lag(hpos) OVER w = 1 AND gpos - lag(gpos) OVER w = 1 THEN 0 ELSE 1 END AS b "
               "FROM mm WINDOW w AS (PARTITION BY pair_id ORDER BY hpos)"),
        ("mp", "SELECT pair_id, count(*) AS m, sum(b) AS chunks FROM mb GROUP BY pair_id"),
        ("ms", "SELECT t.pair_id, CAST(coalesce(mp.m, 0) AS DOUBLE) AS m, mp.chunks, "
               "CAST(coalesce(mp.m, 0) AS DOUBLE) / greatest(len(t.h), 1) AS p, "
               "CAST(coalesce(mp.m, 0) AS DOUBLE) / greatest(len(t.g), 1) AS r FROM mt_t t LEFT JOIN mp ON t.pair_id = mp.pair_id"),
    ]
    return with_fixtures([pairs], *ctes) + (
        "SELECT pair_id, round(CASE WHEN m = 0 THEN 0.0 ELSE (p * r / (0.9 * p + 0.1 * r)) "
        "* (1 - 0.5 * pow(chunks / m, 3.0)) END, 6) AS meteor FROM ms")


ORACLE["meteor"] = _meteor("pairs_conv")
ORACLE["meteor_lead"] = _meteor("pairs_lead")


# --- coverage and cloze ---------------------------------------------------------------


def coverage_ctes(pairs: str, with_transcript: bool) -> list[tuple[str, str]]:
    tk = sp.tok
    ctes = [
        ("nd", "SELECT CAST(count(*) AS DOUBLE) AS n FROM documents"),
        ("idft", f"SELECT token, round(ln((nd.n + 1.0) / (count(*) + 1.0)), 6) AS w FROM "
                 f"(SELECT unnest(list_distinct({tk('text')})) AS token FROM documents), nd GROUP BY token, nd.n"),
        ("stop", f"SELECT token FROM (SELECT unnest({tk('text')}) AS token FROM documents) GROUP BY token "
                 f"ORDER BY count(*) DESC, token LIMIT 50"),
        ("terms", f"SELECT pair_id, 0 AS side, unnest(list_distinct({tk('gold')})) AS token FROM {pairs} "
                  f"UNION ALL SELECT pair_id, 1, unnest(list_distinct({tk('predicted')})) FROM {pairs}"),
        ("tw", "SELECT t.pair_id, t.side, t.token, coalesce(i.w, ln(nd.n + 1.0)) AS w FROM terms t "
               "LEFT JOIN idft i ON t.token = i.token, nd WHERE length(t.token) >= 4 "
               "AND t.token NOT IN (SELECT token FROM stop)"),
        ("pt", "SELECT pair_id, token, w, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS in_g, "
               "max(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS in_h FROM tw GROUP BY pair_id, token, w"),
        ("sm", "SELECT p.pair_id, coalesce(sum(w * in_g), 0.0) AS Wg, coalesce(sum(w * in_h), 0.0) AS Wh, "
               f"coalesce(sum(w * in_g * in_h), 0.0) AS Wgh FROM {pairs} p LEFT JOIN pt ON p.pair_id = pt.pair_id "
               "GROUP BY p.pair_id"),
    ]
    rg, pg = safe_div("Wgh", "Wg"), safe_div("Wgh", "Wh")
    if not with_transcript:
        ctes.append(("cov", f"SELECT pair_id, {pg} AS precision, {rg} AS recall FROM sm"))
        return ctes
    ctes += [
        ("tt", f"SELECT conv_id, token, coalesce(i.w, ln(nd.n + 1.0)) AS w FROM "
               f"(SELECT conv_id, unnest(list_distinct({tk('transcript')})) AS token FROM transcripts) x "
               f"LEFT JOIN idft i USING (token), nd WHERE length(token) >= 4 AND token NOT IN (SELECT token FROM stop)"),
        ("wt", "SELECT t.conv_id, (t.transcript IS NOT NULL AND t.transcript <> '') AS has_t, "
               "coalesce((SELECT sum(w) FROM tt WHERE tt.conv_id = t.conv_id), 0.0) AS Wt FROM transcripts t"),
        ("th", f"SELECT p.pair_id, coalesce(sum(tt.w), 0.0) AS Wth FROM {pairs} p "
               f"LEFT JOIN tw ON tw.pair_id = p.pair_id AND tw.side = 1 "
               f"LEFT JOIN tt ON tt.conv_id = p.conv_id AND tt.token = tw.token GROUP BY p.pair_id"),
        ("cov", f"SELECT sm.pair_id, CASE WHEN coalesce(wt.has_t, false) THEN ({pg} + {safe_div('Wth', 'Wh')}) / 2 "
                f"ELSE {pg} END AS precision, CASE WHEN coalesce(wt.has_t, false) THEN "
                f"({rg} + {safe_div('Wth', 'Wt')}) / 2 ELSE {rg} END AS recall "
                f"FROM sm JOIN {pairs} p ON sm.pair_id = p.pair_id LEFT JOIN wt ON wt.conv_id = p.conv_id "
                f"LEFT JOIN th ON th.pair_id = sm.pair_id"),
    ]
    return ctes


def _coverage(pairs: str, with_transcript: bool) -> str:
    fx = [pairs] + (["transcripts"] if with_transcript else [])
    return with_fixtures(fx, *coverage_ctes(pairs, with_transcript)) + (
        f"SELECT pair_id, {r6(f_measure('precision', 'recall'))} AS fscore, {r6('precision')} AS precision, "
        f"{r6('recall')} AS recall FROM cov")


ORACLE["answer_coverage"] = _coverage("pairs_conv", True)
ORACLE["answer_coverage_lead"] = _coverage("pairs_lead", False)


def _cloze(pairs: str) -> str:
    tk = sp.tok
    ctes = bigram_occ("documents", "doc_id", "text", "tr") + [
        ("cc", "SELECT v, w, count(*) AS c FROM tr WHERE length(w) >= 4 GROUP BY v, w"),
        ("tp", f"SELECT pair_id, {tk('gold')} AS g, {tk('predicted')} AS h FROM {pairs}"),
        ("pos", "SELECT pair_id, g, unnest(range(1, len(g) + 1)) AS i FROM tp"),
        ("masks", "SELECT pair_id, i, g[i - 1] AS v, g[i] AS answer FROM pos "
                  "WHERE i >= 2 AND i % 6 = 0 AND length(g[i]) >= 4"),
        ("base", "SELECT v, w AS w_base, c AS s_base FROM (SELECT v, w, c, row_number() OVER "
                 "(PARTITION BY v ORDER BY c DESC, w) AS rn FROM cc) WHERE rn = 1"),
        ("pw", "SELECT DISTINCT pair_id, unnest(h) AS w FROM tp"),
        ("mpv", "SELECT DISTINCT pair_id, v FROM masks"),
        ("hcand", "SELECT m.pair_id, m.v, cc.w, cc.c FROM mpv m JOIN cc ON m.v = cc.v "
                  "JOIN pw ON pw.pair_id = m.pair_id AND pw.w = cc.w"),
        ("help", "SELECT pair_id, v, w AS w_help FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY pair_id, v ORDER BY c DESC, w) AS rn FROM hcand) WHERE rn = 1"),
    ] + bigram_occ(pairs, "pair_id", "predicted", "pbo") + [
        ("pb", "SELECT k AS pair_id, v, w, count(*) AS cp FROM pbo WHERE length(w) >= 4 GROUP BY k, v, w"),
        ("tcand", "SELECT pb.pair_id, pb.v, pb.w, coalesce(cc.c, 0) + 10 * pb.cp AS s FROM pb "
                  "JOIN mpv ON mpv.pair_id = pb.pair_id AND mpv.v = pb.v LEFT JOIN cc ON cc.v = pb.v AND cc.w = pb.w "
                  "UNION ALL SELECT mpv.pair_id, mpv.v, base.w_base, base.s_base FROM mpv JOIN base ON mpv.v = base.v"),
        ("tune", "SELECT pair_id, v, w AS w_tune FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY pair_id, v ORDER BY s DESC, w) AS rn FROM tcand) WHERE rn = 1"),
        ("per", "SELECT m.pair_id, count(*) AS masked, "
                "CAST(sum(CASE WHEN m.answer = b.w_base THEN 1 ELSE 0 END) AS BIGINT) AS base_correct, "
                "CAST(sum(CASE WHEN m.answer = coalesce(h.w_help, b.w_base) THEN 1 ELSE 0 END) AS BIGINT) AS help_correct, "
                "CAST(sum(CASE WHEN m.answer = t.w_tune THEN 1 ELSE 0 END) AS BIGINT) AS tune_correct "
                "FROM masks m LEFT JOIN base b ON m.v = b.v LEFT JOIN help h ON h.pair_id = m.pair_id AND h.v = m.v "
                "LEFT JOIN tune t ON t.pair_id = m.pair_id AND t.v = m.v GROUP BY m.pair_id"),
    ]
    return with_fixtures([pairs], *ctes) + f"""
SELECT p.pair_id, CAST(coalesce(masked, 0) AS BIGINT) AS masked, coalesce(base_correct, 0) AS base_correct,
  coalesce(help_correct, 0) AS help_correct, coalesce(tune_correct, 0) AS tune_correct,
  round(CASE WHEN masked > 0 THEN (help_correct - base_correct) / masked END, 6) AS blanc_help,
  round(CASE WHEN masked > 0 THEN (tune_correct - base_correct) / masked END, 6) AS blanc_tune
FROM {pairs} p LEFT JOIN per ON p.pair_id = per.pair_id"""


ORACLE["cloze_gain_lead"] = _cloze("pairs_lead")


# --- vector metrics ----------------------------------------------------------------------


def vector_ctes(pairs: str) -> list[tuple[str, str]]:
    dbl = "CAST(embedding AS DOUBLE[])"
    return vocab_ctes(pairs) + token_occ_ctes(pairs, "vo") + [
        ("vid", "SELECT token, rank % (SELECT count(*) FROM embeddings) AS vec_id FROM vocab"),
        ("unit", f"SELECT vec_id, list_transform({dbl}, lambda x: x / sqrt(list_dot_product({dbl}, {dbl}))) AS u "
                 f"FROM embeddings"),
        ("pv", "SELECT o.pair_id, o.side, v.vec_id, count(*) AS n FROM vo_o o JOIN vid v ON o.token = v.token "
               "GROUP BY o.pair_id, o.side, v.vec_id"),
        ("pvu", "SELECT pv.*, unit.u FROM pv JOIN unit ON pv.vec_id = unit.vec_id"),
        ("cs", "SELECT h.pair_id, h.vec_id AS hv, h.n AS hn, g.vec_id AS gv, g.n AS gn, "
               "list_dot_product(h.u, g.u) AS c FROM pvu h JOIN pvu g ON h.pair_id = g.pair_id "
               "AND h.side = 1 AND g.side = 0"),
        ("bh", "SELECT pair_id, hv, any_value(hn) AS n, max(c) AS c FROM cs GROUP BY pair_id, hv"),
        ("bg", "SELECT pair_id, gv, any_value(gn) AS n, max(c) AS c FROM cs GROUP BY pair_id, gv"),
        ("sh", "SELECT pair_id, sum(n * c) / sum(n) AS p, sum(n * sqrt(greatest(2.0 - 2.0 * c, 0.0))) / sum(n) AS dh "
               "FROM bh GROUP BY pair_id"),
        ("sg", "SELECT pair_id, sum(n * c) / sum(n) AS r, sum(n * sqrt(greatest(2.0 - 2.0 * c, 0.0))) / sum(n) AS dg "
               "FROM bg GROUP BY pair_id"),
        ("vs", f"SELECT p.pair_id, coalesce(sh.p, 0.0) AS p, coalesce(sg.r, 0.0) AS r, "
               f"CASE WHEN sh.p IS NULL THEN NULL ELSE 1.0 - greatest(sh.dh, sg.dg) END AS mover "
               f"FROM {pairs} p LEFT JOIN sh ON p.pair_id = sh.pair_id LEFT JOIN sg ON p.pair_id = sg.pair_id"),
    ]


def _embedding(pairs: str) -> str:
    return with_fixtures([pairs], *vector_ctes(pairs)) + (
        f"SELECT pair_id, {r6('p')} AS em_p, {r6('r')} AS em_r, {r6(f_measure('p', 'r'))} AS em_f FROM vs")


ORACLE["embedding_match"] = _embedding("pairs_conv")
ORACLE["embedding_match_lead"] = _embedding("pairs_lead")
ORACLE["mover_score"] = with_fixtures(["pairs_conv"], *vector_ctes("pairs_conv")) + (
    f"SELECT pair_id, {r6('mover')} AS mover_score FROM vs")


def _mover_idf() -> str:
    far = "sum(w * sqrt(greatest(2.0 - 2.0 * c, 0.0))) / sum(w)"
    ctes = [("rf", """
SELECT pair_id, 0 AS ref, gold AS x FROM pairs_conv WHERE gold IS NOT NULL
UNION ALL
SELECT p.pair_id, 1, n.text FROM pairs_conv p JOIN conversations n
ON n.conv_id = p.conv_id AND n.turn = p.pair_id % 4294967296 + 2 AND n.role = 'user' WHERE n.text IS NOT NULL"""),
            ("hy", "SELECT pair_id, -1 AS ref, predicted AS x FROM pairs_conv")]
    for s, texts in (("g", "rf"), ("h", "hy")):
        ctes += [
            (f"{s}t", f"SELECT pair_id, ref, {sp.tok('x')} AS t FROM {texts}"),
            (f"{s}df", f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM {s}t) GROUP BY token"),
            (f"{s}i", f"SELECT token, round(ln(((SELECT CAST(count(*) AS DOUBLE) FROM {s}t) + 1.0) / (df + 1.0)), 6) AS idf "
                      f"FROM {s}df"),
            (f"{s}w", f"SELECT pair_id, ref, vec_id, sum(idf) AS w FROM (SELECT pair_id, ref, unnest(t) AS token FROM {s}t) o "
                      f"JOIN {s}i USING (token) JOIN vid USING (token) WHERE idf > 0 GROUP BY pair_id, ref, vec_id"),
            (f"{s}u", f"SELECT {s}w.*, unit.u FROM {s}w JOIN unit USING (vec_id)"),
        ]
    ctes += [
        ("near", "SELECT g.pair_id, g.ref, g.vec_id AS gv, g.w AS gw, h.vec_id AS hv, h.w AS hw, "
                 "list_dot_product(h.u, g.u) AS c FROM gu g JOIN hu h ON g.pair_id = h.pair_id"),
        ("nh", f"SELECT pair_id, ref, {far} AS far FROM (SELECT pair_id, ref, hv, any_value(hw) AS w, max(c) AS c FROM near "
               "GROUP BY pair_id, ref, hv) GROUP BY pair_id, ref"),
        ("ng", f"SELECT pair_id, ref, {far} AS far FROM (SELECT pair_id, ref, gv, any_value(gw) AS w, max(c) AS c FROM near "
               "GROUP BY pair_id, ref, gv) GROUP BY pair_id, ref"),
        ("sc", "SELECT pair_id, ref, 1.0 - greatest(nh.far, ng.far) AS score FROM nh JOIN ng USING (pair_id, ref)"),
    ]
    return with_fixtures(["pairs_conv"], *vector_ctes("pairs_conv"), *ctes) + (
        "SELECT p.pair_id, count(score) AS references, round(avg(score), 6) AS mover_score_idf "
        "FROM pairs_conv p LEFT JOIN sc ON p.pair_id = sc.pair_id GROUP BY p.pair_id")


ORACLE["mover_score_idf"] = _mover_idf()


# --- model seams ------------------------------------------------------------------------

ORACLE["score_with"] = with_fixtures(["pairs_conv"]) + (
    "SELECT pair_id, round(CAST(length(predicted) AS DOUBLE) / nullif(length(gold), 0), 6) AS length_ratio "
    "FROM pairs_conv")

ORACLE["learned_score_1f"] = with_fixtures(["pairs_doc"], *_DS, (
    "lab", "SELECT ds.pair_id, ds.rouge1_f AS x, CAST(l.quality AS DOUBLE) AS y FROM ds "
           "JOIN labels l ON l.doc_id = ds.pair_id WHERE ds.rouge1_f IS NOT NULL"), (
    "st", "SELECT avg(x) AS mu, stddev_pop(x) AS sd, sign(regr_slope(y, x)) AS sg FROM lab")) + (
    "SELECT pair_id, round(least(greatest(50.0 + 10.0 * CASE WHEN sd > 0 THEN sg * (x - mu) / sd ELSE 0.0 END, "
    "0.0), 100.0), 6) AS learned_score FROM lab, st")


_MREF = ("mref", """
SELECT p.pair_id, 0 AS ref_id, p.gold FROM pairs_conv p
UNION ALL
SELECT p.pair_id, 1, n.text FROM pairs_conv p
JOIN conversations n ON n.conv_id = p.conv_id AND n.turn = p.pair_id % 4294967296 + 2 AND n.role = 'user'""")


def _bleu_multi() -> str:
    t13 = sp.tok13a
    unions = []
    for n in range(1, 5):
        unions.append(f"SELECT pair_id, -1 AS side, {n} AS n, unnest({sp.ngrams('t', n)}) AS gram FROM bm_h")
        unions.append(f"SELECT pair_id, ref_id AS side, {n} AS n, unnest({sp.ngrams('t', n)}) AS gram FROM bm_r")
    ms = ", ".join(f"CAST(coalesce(sum(CASE WHEN n = {n} THEN least(coalesce(ch, 0), coalesce(cr, 0)) ELSE 0 END), 0) "
                   f"AS BIGINT) AS m{n}" for n in range(1, 5))
    ctes = [
        _MREF,
        ("bm_h!", f"SELECT pair_id, {t13('predicted')} AS t FROM pairs_conv"),
        ("bm_r!", f"SELECT pair_id, ref_id, {t13('gold')} AS t FROM mref"),
        ("bm_g", " UNION ALL ".join(unions)),
        ("bm_s", "SELECT pair_id, side, n, gram, count(*) AS c FROM bm_g GROUP BY pair_id, side, n, gram"),
        ("bm_pg", "SELECT pair_id, n, gram, max(CASE WHEN side = -1 THEN c END) AS ch, "
                  "max(CASE WHEN side >= 0 THEN c END) AS cr FROM bm_s GROUP BY pair_id, n, gram"),
        ("bm_m", f"SELECT pair_id, {ms} FROM bm_pg GROUP BY pair_id"),
        ("bm_l", "SELECT h.pair_id, CAST(len(h.t) AS BIGINT) AS hyp_len, "
                 "(SELECT CAST(min(len(r.t)) AS BIGINT) FROM bm_r r WHERE r.pair_id = h.pair_id) AS ref_len FROM bm_h h"),
        ("st", "SELECT l.pair_id, hyp_len, ref_len, " + ", ".join(f"coalesce(m.m{n}, 0) AS m{n}" for n in range(1, 5))
               + ", " + ", ".join(f"CAST(greatest(hyp_len - {n - 1}, 0) AS BIGINT) AS t{n}" for n in range(1, 5))
               + " FROM bm_l l LEFT JOIN bm_m m ON l.pair_id = m.pair_id"),
    ]
    return with_fixtures(["pairs_conv"], *ctes) + _bleu_select("st", ["pair_id"])


ORACLE["bleu_multi_ref"] = _bleu_multi()

ORACLE["unannotated_pairs"] = with_fixtures(["pairs_lead"], *sp.overlap_sql("pairs_lead", sp.tok, (1,))) + (
    f"SELECT t.pair_id, {r6(f_measure('(coalesce(ov.ov_1, 0) / greatest(len(t.h), 1))', '(coalesce(ov.ov_1, 0) / greatest(len(t.g), 1))'))} "
    "AS rouge1_f FROM ov_t t LEFT JOIN ov ON t.pair_id = ov.pair_id "
    "WHERE t.pair_id NOT IN (SELECT doc_id FROM labels)")

_R1 = sp.overlap_sql("pairs_lead", sp.tok, (1,))
ORACLE["write_scores_by_system"] = with_fixtures(["pairs_lead"], *_R1) + (
    "SELECT t.pair_id, "
    + ", ".join([f"{r6('(coalesce(ov.ov_1, 0) / greatest(len(t.h), 1))')} AS rouge1_p",
                 f"{r6('(coalesce(ov.ov_1, 0) / greatest(len(t.g), 1))')} AS rouge1_r",
                 f"{r6(f_measure('(coalesce(ov.ov_1, 0) / greatest(len(t.h), 1))', '(coalesce(ov.ov_1, 0) / greatest(len(t.g), 1))'))} AS rouge1_f"])
    + ", p.system FROM ov_t t LEFT JOIN ov ON t.pair_id = ov.pair_id JOIN pairs_lead p ON p.pair_id = t.pair_id")


# --- longest common subsequences, stems ---------------------------------------------------

_LCS_T = ("lt!", f"SELECT pair_id AS k, {sp.tok('gold')} AS g, {sp.tok('predicted')} AS h FROM pairs_conv")
ORACLE["rouge_l"] = with_fixtures(["pairs_conv"], _LCS_T, *sq.lcs_ctes("lt")) + (
    f"SELECT t.k AS pair_id, {sq.prf('lcs.n', 'rougeL')} FROM lt t JOIN lcs ON t.k = lcs.k")
ORACLE["rouge_lsum"] = with_fixtures(["pairs_conv"], *sq.sentence_ctes("pairs_conv", "ss"), *sq.flat_ctes("ss", "sf"),
                                     *sq.union_lcs_ctes("ss", "su")) + (
    f"SELECT t.k AS pair_id, {sq.prf('coalesce(su.n, 0)', 'rougeLsum')} FROM sf t LEFT JOIN su ON t.k = su.k")
_STEMMED, _STEMMED_SELECT = sq.stemmed_rouge("pairs_conv")
ORACLE["rouge_stemmed"] = with_fixtures(["pairs_conv"], *_STEMMED) + _STEMMED_SELECT


# --- all metrics, evaluation of a run ------------------------------------------------------

_BY_SYSTEM = ("pairs_sys", "SELECT *, 's' || (conv_id % 5) AS system FROM pairs_conv")


def _all_metrics() -> str:
    vec = [c for c in vector_ctes("pairs_conv")]
    ctes = [*_RB, _LCS_T, *sq.lcs_ctes("lt"), ("mtr", _body(ORACLE["meteor"])), ("crf", _body(ORACLE["chrf"])),
            *perplexity_ctes("pairs_conv", "pair_id", "predicted"), *vec, _BY_SYSTEM]
    return with_fixtures(["pairs_conv"], *ctes) + f"""
SELECT p.system, p.pair_id, p.gold, p.predicted, r.* EXCLUDE (pair_id), {sq.prf('lcs.n', 'rougeL', 'len(lt.h)', 'len(lt.g)')},
  {r6('vs.p')} AS em_p, {r6('vs.r')} AS em_r, {r6(f_measure('vs.p', 'vs.r'))} AS em_f, b.* EXCLUDE (pair_id),
  mtr.meteor, crf.chrf, ppl.n_tokens, ppl.perplexity
FROM pairs_sys p JOIN rouge r USING (pair_id) JOIN bleu_s b USING (pair_id) JOIN lt ON lt.k = p.pair_id
JOIN lcs ON lcs.k = p.pair_id JOIN vs ON vs.pair_id = p.pair_id JOIN mtr ON mtr.pair_id = p.pair_id
JOIN crf ON crf.pair_id = p.pair_id JOIN ppl ON ppl.k = p.pair_id"""


def _body(sql: str) -> str:
    """A query with its own WITH clause, as the body of another's."""
    return f"SELECT * FROM ({sql})"


ORACLE["all_metrics"] = _all_metrics()

# Decoded texts: the known tokens, joined by spaces (no sentence ends are left).
_DECODED = ("dec!", f"SELECT pair_id, array_to_string({sp.tok('gold')}, ' ') AS gold, "
                    f"array_to_string({sp.tok('predicted')}, ' ') AS predicted FROM pairs_conv")
_DEC_CTES, _DEC_SELECT = sq.stemmed_rouge("dec")
_EVALUATED = [_DECODED, *_DEC_CTES, ("rs", _DEC_SELECT), (
    "evr", "SELECT rs.pair_id, d.predicted AS prediction, d.gold AS label, "
           + ", ".join(f"round(rs.{r}_f * 100, 4) AS {r}" for r in ("rouge1", "rouge2", "rougeL", "rougeLsum"))
           + f", CAST(len({sp.tok('d.predicted')}) AS BIGINT) AS gen_len FROM rs JOIN dec d USING (pair_id)")]
# A text without tokens is written to CSV, and read again, as none.
ORACLE["evaluate_predictions"] = with_fixtures(["pairs_conv"], *_EVALUATED) + (
    "SELECT pair_id, nullif(prediction, '') AS prediction, nullif(label, '') AS label, rouge1, rouge2, rougeL, rougeLsum, gen_len FROM evr")
ORACLE["evaluate_summary"] = with_fixtures(["pairs_conv"], *_EVALUATED) + (
    "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("rouge1", "rouge2", "rougeL", "rougeLsum", "gen_len"))
    + ", count(*) AS rows FROM evr")

ORACLE["mean_perplexity"] = with_fixtures([], *perplexity_ctes("documents", "doc_id", "text")) + (
    "SELECT round(avg(perplexity), 6) AS mean_perplexity, count(perplexity) AS texts FROM ppl")

ORACLE["map_batches"] = with_fixtures(["pairs_conv"], (
    "bt", "SELECT pair_id, length(predicted) AS n, (row_number() OVER (ORDER BY pair_id) - 1) // 64 AS b FROM pairs_conv")) + (
    "SELECT pair_id, count(*) OVER (PARTITION BY b) AS batch_rows, round(n - avg(n) OVER (PARTITION BY b), 6) AS centred FROM bt")
