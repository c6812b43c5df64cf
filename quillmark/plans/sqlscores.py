"""DuckDB SQL of the stemmer, of longest common subsequences and of the scores built on them.

Written apart from the Spark side: the stemmer as regular expressions over a
word table, the subsequence as a recursive query over anti-diagonals.
"""

from __future__ import annotations

from quillmark.plans import sqlparts as sp
from quillmark.plans.sqlparts import f_measure, r6, safe_div

Ctes = list[tuple[str, str]]

# Fixed values of the stemming algorithm: consonant and vowel groups, and its suffixes.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE, _VOWEL = f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_STEP2 = ("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous "
          "ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _swap(rules: str) -> str:
    out = "CASE"
    for rule in rules.split():
        suffix, new = rule.split(":")
        stem = f"w[:-{len(suffix) + 1}]"
        out += f" WHEN ends_with(w, '{suffix}') THEN CASE WHEN regexp_matches({stem}, '{_SOME}') THEN {stem} || '{new}' ELSE w END"
    return out + " ELSE w END"


def _drop4() -> str:
    out = "CASE"
    for suffix in _STEP4.split():
        stem = f"w[:-{len(suffix) + 1}]"
        more = f" AND regexp_matches({stem}, '[st]$')" if suffix == "ion" else ""
        out += f" WHEN ends_with(w, '{suffix}') THEN CASE WHEN regexp_matches({stem}, '{_MORE}'){more} THEN {stem} ELSE w END"
    return out + " ELSE w END"


def stem_ctes(words: str, name: str = "stems") -> Ctes:
    """CTE ``name(token, stem)`` of the tokens of 4+ characters in ``words(token)``."""
    double = "right(w, 1) = left(right(w, 2), 1) AND length(w) > 1"
    steps = [
        # A y at the front is a consonant; the capital keeps it apart.
        "CASE WHEN left(w, 1) = 'y' THEN 'Y' || w[2:] ELSE w END",
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN w[:-3] WHEN ends_with(w, 'ss') THEN w "
        "WHEN ends_with(w, 's') THEN w[:-2] ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(w[:-4], '{_SOME}') THEN w[:-2] ELSE w END "
        f"WHEN ends_with(w, 'ed') AND regexp_matches(w[:-3], '{_VOWEL}') THEN w[:-3] || '+' "
        f"WHEN ends_with(w, 'ing') AND regexp_matches(w[:-4], '{_VOWEL}') THEN w[:-4] || '+' ELSE w END",
    ]
    cut = "replace(w, '+', '')"
    steps += [
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches({cut}, '(at|bl|iz)$') THEN {cut} || 'e' "
        f"WHEN regexp_matches({cut}, '[^aeiouylsz]$') AND {double.replace('w', cut)} THEN {cut}[:-2] "
        f"WHEN regexp_matches({cut}, '{_SHORT}') THEN {cut} || 'e' ELSE {cut} END",
        f"CASE WHEN ends_with(w, 'y') AND regexp_matches(w[:-2], '{_VOWEL}') THEN w[:-2] || 'i' ELSE w END",
        _swap(_STEP2), _swap(_STEP3), _drop4(),
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches(w[:-2], '{_MORE}') OR regexp_matches(w[:-2], '{_ONE}') "
        f"AND NOT regexp_matches(w[:-2], '{_SHORT}')) THEN w[:-2] ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_MORE}') THEN w[:-2] ELSE w END",
        "replace(w, 'Y', 'y')",
    ]
    ctes = [(f"{name}_0", f"SELECT DISTINCT token, token AS w FROM {words} WHERE length(token) >= 4")]
    for k, step in enumerate(steps):
        ctes.append((f"{name}_{k + 1}", f"SELECT token, {step} AS w FROM {name}_{k}"))
    return [*ctes, (name, f"SELECT token, w AS stem FROM {name}_{len(steps)}")]


def lcs_ctes(src: str, name: str = "lcs") -> Ctes:
    """CTE ``name(k, n)``: the length of the LCS of lists ``g`` and ``h`` of ``src(k, g, h)``.

    One step an anti-diagonal: a cell looks at the one before (left, above) and
    the one before that (left and above), kept as lists by position in ``g``.
    """
    cell = ("CASE WHEN i = 0 OR d - i < 1 OR d - i > len(h) THEN 0 WHEN g[i] = h[d - i] THEN p2[i] + 1 "
            "ELSE greatest(p1[i + 1], p1[i]) END")
    return [(f"{name}_d", f"""
        SELECT k, g, h, 1 AS d, list_transform(range(len(g) + 1), lambda i: 0) AS p2,
               list_transform(range(len(g) + 1), lambda i: 0) AS p1 FROM {src} WHERE len(g) > 0 AND len(h) > 0
        UNION ALL
        SELECT k, g, h, d, p1, list_transform(range(len(g) + 1), lambda i: CAST({cell} AS INTEGER))
        FROM (SELECT k, g, h, d + 1 AS d, p2, p1 FROM {name}_d WHERE d < len(g) + len(h))"""),
            (name, f"SELECT s.k, coalesce(x.p1[len(s.g) + 1], 0) AS n FROM {src} s "
                   f"LEFT JOIN {name}_d x ON s.k = x.k AND x.d = len(s.g) + len(s.h)")]


def union_lcs_ctes(src: str, name: str = "ulcs") -> Ctes:
    """CTE ``name(k, n)``: hits of the union LCS, from ``src(k, side, s, toks)``:
    sentence ``s`` of side 0 (gold) or 1 (predicted) as a token list.

    Cells hold the matched positions: on a tie the path goes on in the shorter
    gold prefix. A token counts at most as often as the predicted text has it.
    """
    cell = ("CASE WHEN i = 0 OR d - i < 1 OR d - i > len(h) THEN CAST([] AS INTEGER[]) "
            "WHEN g[i] = h[d - i] THEN list_append(p2[i], CAST(i AS INTEGER)) "
            "WHEN len(p1[i + 1]) > len(p1[i]) THEN p1[i + 1] ELSE p1[i] END")
    none = "list_transform(range(len(g) + 1), lambda i: CAST([] AS INTEGER[]))"
    return [(f"{name}_p", f"""SELECT a.k, a.s AS gs, b.s AS hs, a.toks AS g, b.toks AS h
                              FROM {src} a JOIN {src} b ON a.k = b.k AND a.side = 0 AND b.side = 1
                              WHERE len(list_intersect(a.toks, b.toks)) > 0"""),
            (f"{name}_d", f"""
        SELECT k, gs, hs, g, h, 1 AS d, {none} AS p2, {none} AS p1 FROM {name}_p
        UNION ALL
        SELECT k, gs, hs, g, h, d, p1, list_transform(range(len(g) + 1), lambda i: {cell})
        FROM (SELECT k, gs, hs, g, h, d + 1 AS d, p2, p1 FROM {name}_d WHERE d < len(g) + len(h))"""),
            (f"{name}_u", f"SELECT DISTINCT k, gs, unnest(p1[len(g) + 1]) AS i FROM {name}_d WHERE d = len(g) + len(h)"),
            (f"{name}_t", f"SELECT u.k, a.toks[u.i] AS t, count(*) AS c FROM {name}_u u "
                          f"JOIN {src} a ON a.k = u.k AND a.side = 0 AND a.s = u.gs GROUP BY u.k, a.toks[u.i]"),
            (f"{name}_h", f"SELECT k, t, count(*) AS c FROM (SELECT k, unnest(toks) AS t FROM {src} WHERE side = 1) GROUP BY k, t"),
            (name, f"SELECT u.k, CAST(sum(least(u.c, h.c)) AS BIGINT) AS n FROM {name}_t u "
                   f"JOIN {name}_h h ON u.k = h.k AND u.t = h.t GROUP BY u.k")]


SENTENCE_LINES = r"regexp_replace({x}, '([.!?])\s+', '\1' || chr(10), 'g')"


def sentence_ctes(pairs: str, name: str, stems: str | None = None) -> Ctes:
    """CTE ``name(k, side, s, toks)``: sentences of both texts as lists of tokens (or of their stems)."""
    lines = " UNION ALL ".join(
        f"SELECT pair_id AS k, {side} AS side, unnest(ls) AS line, generate_subscripts(ls, 1) AS s FROM "
        f"(SELECT pair_id, string_split({SENTENCE_LINES.format(x=col)}, chr(10)) AS ls FROM {pairs})"
        for side, col in enumerate(("gold", "predicted")))
    out = [(f"{name}_l", lines), (f"{name}_r!", f"SELECT k, side, s, {sp.tok('line')} AS toks FROM {name}_l")]
    if stems is None:
        return [*out, (f"{name}!", f"SELECT * FROM {name}_r")]
    return [*out,
            (f"{name}_w", f"SELECT DISTINCT unnest(toks) AS token FROM {name}_r"), *stem_ctes(f"{name}_w", stems),
            (f"{name}_o", f"SELECT k, side, s, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_r"),
            (f"{name}_z", f"SELECT o.k, o.side, o.s, list(coalesce(x.stem, o.token) ORDER BY pos) AS toks "
                          f"FROM {name}_o o LEFT JOIN {stems} x USING (token) GROUP BY o.k, o.side, o.s"),
            (f"{name}!", f"SELECT r.k, r.side, r.s, coalesce(z.toks, CAST([] AS VARCHAR[])) AS toks "
                         f"FROM {name}_r r LEFT JOIN {name}_z z USING (k, side, s)")]


def flat_ctes(sentences: str, name: str) -> Ctes:
    """CTE ``name(k, g, h)``: the sentences' tokens in one list a side."""
    return [(f"{name}!", f"SELECT k, flatten(list(toks ORDER BY s) FILTER (side = 0)) AS g, "
                         f"flatten(list(toks ORDER BY s) FILTER (side = 1)) AS h FROM {sentences} GROUP BY k")]


def prf(match: str, name: str, h: str = "len(t.h)", g: str = "len(t.g)") -> str:
    p, r = safe_div(match, h), safe_div(match, g)
    return f"{r6(p)} AS {name}_p, {r6(r)} AS {name}_r, {r6(f_measure(p, r))} AS {name}_f"


def overlap_lists(src: str, ns, name: str) -> Ctes:
    """CTE ``name(k, ov_<n>...)`` of clipped n-gram matches of ``src(k, g, h)``."""
    ctes = sp.overlap_sql("unused", sp.tok, ns, name=name)
    return [(n, q.replace(f"{name}_t", src).replace("pair_id", "k")) for n, q in ctes[1:]]


def stemmed_rouge(pairs: str) -> tuple[Ctes, str]:
    """CTEs and columns of ROUGE-1, 2, L and Lsum (P, R, F) on stems."""
    ctes = [*sentence_ctes(pairs, "ss", "stems"), *flat_ctes("ss", "sf"), *overlap_lists("sf", (1, 2), "so"),
            *lcs_ctes("sf", "sl"), *union_lcs_ctes("ss", "su")]
    cols = []
    for n in (1, 2):
        o = f"coalesce(so.ov_{n}, 0)"
        p, r = f"({o} / greatest(len(t.h) - {n - 1}, 1))", f"({o} / greatest(len(t.g) - {n - 1}, 1))"
        cols.append(f"{r6(p)} AS rouge{n}_p, {r6(r)} AS rouge{n}_r, {r6(f_measure(p, r))} AS rouge{n}_f")
    cols += [prf("sl.n", "rougeL"), prf("coalesce(su.n, 0)", "rougeLsum")]
    return ctes, (f"SELECT t.k AS pair_id, {', '.join(cols)} FROM sf t LEFT JOIN so ON t.k = so.k "
                  "LEFT JOIN sl ON t.k = sl.k LEFT JOIN su ON t.k = su.k")
