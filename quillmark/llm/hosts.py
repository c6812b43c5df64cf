"""Host-level quality rules (DataFrame functions only).

Each document is measured inside its row (no shuffle of words); rule failures
are then summed by host (``source``), each host's failure rate is shrunk
towards all hosts by a beta prior fitted to the hosts' rates, and the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.tables import staged
from quillmark.operators.joins import sized_broadcast_join

# Fixed values of the base rules.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
# Fixed values of the host rules: a document fails ``symbols`` with more symbols
# than a tenth of its word characters, ``lines`` with repeated lines for more than
# every tenth word, and a host fails with a shrunk rate above one half.
SYMBOL_PER_CHAR, LINE_PER_WORD, MAX_HOST_RATE = 0.1, 0.1, 0.5
#: The prior weighs as much as so many documents at least and at most.
MIN_PRIOR, MAX_PRIOR = 1.0, 10_000.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` reads it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows found twice or more in the array.

    Windows are compared by a 64-bit hash. Sorting (hash, position) pairs
    brings equal windows side by side: n log n in the row, whatever repeats.
    """
    def covered(at: Column) -> Column:
        # Positions of repeated windows in order: each covers up to the next one's start.
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))),
                           lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(pairs, lambda s: F.transform(s, lambda x, j: F.when(
            (x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])),
            x["i"])))
        at = F.array_sort(F.filter(found, lambda i: i.isNotNull()))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(at, covered))

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
        return let(windows, of_hashes)

    return let(words, of_words)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the base measures of every text (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    words = words_of(F.col("text"))
    m = docs.select(
        "doc_id", "source",
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"))).alias("m"),
        (F.size(F.split(text, SYMBOL)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"))
    return m.select("doc_id", "source", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines",
                    "m.n_repeat_words",
                    ((F.col("m.n_words") < MIN_WORDS)
                     | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
                     ).alias("base_failed"))


def rules() -> dict[str, Column]:
    """Failures that are counted by host."""
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") > SYMBOL_PER_CHAR * F.col("word_chars"),
        "lines": F.col("n_dup_lines") > LINE_PER_WORD * F.col("n_words"),
    }


def host_verdicts(rows: DataFrame) -> DataFrame:
    """``host, host_failed`` and each rule's shrunk rate, from measured documents.

    The prior of a rule is the beta distribution with the mean and variance
    of the hosts' raw rates (method of moments, its weight kept between
    ``MIN_PRIOR`` and ``MAX_PRIOR`` documents). Only two moments a rule reach
    the driver.
    """
    checks = rules()
    hosts = rows.groupBy(F.col("source").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in checks.items()])
    hosts = staged(hosts, "hosts")
    rate = {k: F.col(f"f_{k}") / F.col("n") for k in checks}
    moments = hosts.agg(*[F.avg(r).alias(f"m_{k}") for k, r in rate.items()],
                        *[F.var_pop(r).alias(f"v_{k}") for k, r in rate.items()]).first()
    shrunk = {}
    for k in checks:
        m, v = moments[f"m_{k}"] or 0.0, moments[f"v_{k}"] or 0.0
        weight = min(MAX_PRIOR, max(MIN_PRIOR, m * (1 - m) / v - 1)) if v > 0 else MAX_PRIOR
        shrunk[k] = (F.col(f"f_{k}") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    failed = F.lit(False)
    for r in shrunk.values():
        failed = failed | (r > MAX_HOST_RATE)
    return hosts.select("host", *[r.alias(f"rate_{k}") for k, r in shrunk.items()],
                        failed.alias("host_failed"))


def judged(docs: DataFrame) -> DataFrame:
    """Base measures, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null
    source is a host of its own. Repeated rows are judged alike; an empty
    table gives no rows; other columns are not read. A document is kept if it
    passes the base rules and its host passes.
    """
    rows = staged(measured(docs), "measured")
    hosts = host_verdicts(rows).select(
        F.to_json(F.struct(F.col("host").alias("h"))).alias("_host"), "host_failed")
    keyed = rows.withColumn("_host", F.to_json(F.struct(F.col("source").alias("h"))))   # null-safe key
    return sized_broadcast_join(keyed, hosts, ["_host"], salt_by=["doc_id"]).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host", "host_failed")


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import documents
    return judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(3, coalesce(nx - i, 3))) AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f1,
             sum((n_symbols > 0.1 * word_chars)::INT) AS f2, sum((n_dup_lines > 0.1 * n_words)::INT) AS f3
      FROM b GROUP BY source),
u AS (SELECT source, n, unnest([1, 2, 3]) AS k, unnest([f1, f2, f3]) AS f FROM f),
p AS (SELECT k, avg(f / n) AS m, var_pop(f / n) AS v FROM u GROUP BY k),
q AS (SELECT k, m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS s FROM p),
h AS (SELECT source, bool_or((f + m * s) / (n + s) > 0.5) AS host_failed FROM u JOIN q USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source
"""
