"""DuckDB SQL fragments for the oracle queries.

The oracle side of every registered query is plain SQL over the driver's
parquet views. These helpers only build SQL text (fixture CTEs and the
tokeniser expressions); they are not used by the Spark side.
"""

from __future__ import annotations


def tok(x: str) -> str:
    """ROUGE tokeniser as a DuckDB list expression."""
    return (f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def tok13a(x: str) -> str:
    s = f"(' ' || replace({x}, chr(10), ' ') || ' ')"
    s = rf"regexp_replace({s}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
    s = rf"regexp_replace({s}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    s = rf"regexp_replace({s}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    s = rf"regexp_replace({s}, '([0-9])(-)', '\1 \2 ', 'g')"
    return f"list_filter(string_split({s}, ' '), lambda t: t <> '')"


def ngrams(lst: str, n: int) -> str:
    return (f"list_transform(range(1, len({lst}) - {n} + 2), "
            f"lambda i: array_to_string({lst}[i:i + {n - 1}], ' '))")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def f_measure(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2.0 * ({p}) * ({r}) / (({p}) + ({r})) END)"


def safe_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


PAIRS_CONV = """
SELECT a.conv_id * 4294967296 + a.turn AS pair_id, a.conv_id, a.text AS gold, b.text AS predicted
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'
"""

TRANSCRIPTS = """
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
"""

PAIRS_LEAD = """
SELECT doc_id AS pair_id, source AS system, substr(text, 1, (2 * length(text) + 2) // 3) AS gold,
       substr(text, length(text) // 3 + 1) AS predicted
FROM documents
"""

PAIRS_DOC = """
SELECT d.doc_id AS pair_id, d.source AS system, d.lang, b.text AS gold, d.text AS predicted, d.n_chars,
       CASE WHEN CAST(substr(d.source, 4) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS arch
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
"""

ANN_DOC = """
SELECT doc_id AS pair_id, 'low_quality' AS error_type, 1 - quality AS present, (1 - quality) + toxic AS severity FROM labels
UNION ALL
SELECT doc_id, 'toxic', toxic, (1 - quality) + toxic FROM labels
"""

CHAL_DOC = """
SELECT d.doc_id AS pair_id, 'long' AS challenge, CASE WHEN n_chars >= 3000 THEN 1 ELSE 0 END AS present FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT d.doc_id, 'non_english', CASE WHEN lang <> 'en' THEN 1 ELSE 0 END FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT d.doc_id, 'many_lines', CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 20 THEN 1 ELSE 0 END FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

DOCS_SPLIT = """
SELECT *, CASE WHEN doc_id % 10 <= 7 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split
FROM documents
"""

FIXTURES = {
    "pairs_conv": PAIRS_CONV,
    "transcripts": TRANSCRIPTS,
    "pairs_lead": PAIRS_LEAD,
    "pairs_doc": PAIRS_DOC,
    "ann_doc": ANN_DOC,
    "chal_doc": CHAL_DOC,
    "docs_split": DOCS_SPLIT,
}


def with_fixtures(names: list[str], *ctes: tuple[str, str]) -> str:
    """``WITH`` clause holding the named fixtures and extra ``(name, sql)`` CTEs."""
    parts = [f"{n} AS ({FIXTURES[n].strip()})" for n in names]
    # A name ending in "!" is a MATERIALIZED CTE (token lists read inside
    # list lambdas must not be re-derived per element).
    parts += [f"{n[:-1]} AS MATERIALIZED ({s.strip()})" if n.endswith("!") else f"{n} AS ({s.strip()})"
              for n, s in ctes]
    # RECURSIVE changes nothing for a query that doesn't read itself.
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def overlap_sql(pairs: str, tokfn, ns, name: str = "ov") -> list[tuple[str, str]]:
    """CTEs ``<name>_t`` (pair_id, g, h) and ``<name>`` (pair_id, ov_<n>...)."""
    unions = []
    for n in ns:
        unions.append(f"SELECT pair_id, 0 AS side, {n} AS n, unnest({ngrams('g', n)}) AS gram FROM {name}_t")
        unions.append(f"SELECT pair_id, 1 AS side, {n} AS n, unnest({ngrams('h', n)}) AS gram FROM {name}_t")
    sums = ", ".join(f"CAST(sum(CASE WHEN n = {n} THEN least(cg, ch) ELSE 0 END) AS BIGINT) AS ov_{n}" for n in ns)
    return [
        (f"{name}_t!", f"SELECT pair_id, {tokfn('gold')} AS g, {tokfn('predicted')} AS h FROM {pairs}"),
        (f"{name}_gr", " UNION ALL ".join(unions)),
        (f"{name}_c", f"SELECT pair_id, n, gram, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS cg, "
                      f"sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS ch FROM {name}_gr GROUP BY pair_id, n, gram"),
        (name, f"SELECT pair_id, {sums} FROM {name}_c GROUP BY pair_id"),
    ]
