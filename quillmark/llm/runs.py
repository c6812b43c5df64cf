"""Periodic runs of words: maximal repetitions of four periods or more.

Each batch of texts is one sequence of word numbers with a number of its own
between documents, recompressed to a run-length grammar
(:mod:`quillmark.llm.recompression`). A run of period p agrees with itself p
words on over three periods at least, so one of every 3p places lies in there:
these harmonic grids are the candidates, n log n of them, and the grammar
extends each to both sides exactly. Row-local: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import Texts, chunks
from quillmark.llm.hosts import let, words_of
from quillmark.llm.recompression import Grammar

# Fixed values of a run: so many periods and so many words at least.
MIN_PERIODS, MIN_WORDS = 4, 6
#: Candidates, and words written, at once.
BLOCK = 1 << 18

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _word_numbers(part: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words (compared whole), from 0 on."""
    if not len(start):
        return np.zeros(0, np.int32)
    inside = np.zeros(len(part.data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    data = part.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(end - start))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy()


def _candidates(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place (from 0) and period of the harmonic grids of documents of ``n`` words."""
    most = np.where(n >= MIN_WORDS, n // MIN_PERIODS, 0)
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (MIN_PERIODS - 1) * period
    count = (n[doc] - period - 1) // step + 1
    done = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + BLOCK, side="right")) - 1)
        c = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), c)
        k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        yield doc[which], k * step[which], period[which]
        lo = hi


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in the document), length and period of every run, by
    document, start and period. ``words`` are numbers from 0 on, document d
    has ``words[bounds[d]:bounds[d + 1]]``."""
    docs = len(bounds) - 1
    n = np.diff(bounds)
    top = int(words.max(initial=-1)) + 1
    # One number that occurs once before each document and after the last.
    seq = np.insert(words.astype(np.int64), bounds, top + np.arange(docs + 1))
    at = bounds[:-1] + np.arange(docs) + 1
    grammar = None
    found = []
    for doc, place, period in _candidates(n):
        i = at[doc] + place
        hit = seq[i] == seq[i + period]
        doc, i, period = doc[hit], i[hit], period[hit]
        if not len(i):
            continue
        grammar = grammar or Grammar(seq)
        right = grammar.extend(i, i + period)
        left = grammar.extend(i - 1, i + period - 1, back=True)
        length = left + period + right
        ok = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        found.append(np.stack([doc[ok], (i - left - at[doc])[ok], length[ok], period[ok]]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    doc, start, length, period = np.concatenate(found, axis=1)
    # A stretch met with multiples of its period has the smallest.
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(doc)]
    doc, start, length, period = doc[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def joined_words(part: Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> pa.Array:
    """Each document's words (places in ``part``) joined by one space."""
    more = np.append(doc[1:] == doc[:-1], False)[:len(doc)]     # a space follows
    size = end - start + more
    out = np.empty(int(size.sum()), np.uint8)
    done = np.append(0, np.cumsum(size))
    for lo in range(0, len(start), BLOCK):
        hi = min(lo + BLOCK, len(start))
        a, b = done[lo], done[hi]
        source = np.arange(a, b) + np.repeat(start[lo:hi] - done[lo:hi], size[lo:hi])
        out[a:b] = part.data[np.minimum(source, len(part.data) - 1)]
        out[done[lo + 1:hi + 1][more[lo:hi]] - 1] = 0x20
    offsets = done[np.searchsorted(doc, np.arange(part.n + 1))]
    return pa.LargeStringArray.from_buffers(part.n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def _runs_of(part: Texts) -> tuple[pa.Array, pa.Array]:
    start, end, word_doc = part.words()
    bounds = part.bounds(word_doc)
    doc, at, length, period = find_runs(_word_numbers(part, start, end), bounds)
    # Words after a run's first period.
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, bounds[doc] + at + period, 1)
    np.add.at(change, bounds[doc] + at + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    text = joined_words(part, start[keep], end[keep], word_doc[keep])
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (at, length, period)],
                                      ["start", "length", "period"])
    offsets = np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), runs), text


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            runs, text = _runs_of(part)
            ids = batch.column(0).slice(part.row, part.n)
            yield pa.RecordBatch.from_arrays([ids, runs, text.cast(pa.string())], names=["doc_id", "runs", "text"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, text``: a row per row of ``docs``.

    ``runs`` holds start, length and smallest period, in words, of every
    maximal repetition of ``MIN_PERIODS`` periods and ``MIN_WORDS`` words or
    more, by start, then period. ``text`` is the words, joined by one space,
    without those that a run holds after its first period. Null, empty and
    blank texts have no runs and an empty text; long texts are searched whole;
    repeated rows and null ids are rows like others; other columns are not
    read; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _search, f"doc_id bigint, runs {RUNS}, text string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: by the crc32 of its id, one document in ten repeats some of its
    words up to its end (a null id: unchanged)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(s):
        a, p = s["a"], s["p"]
        return F.array_join(F.transform(s["w"], lambda w, i: F.when(i < a, w).otherwise(
            F.get(s["w"], (a + F.pmod(i - a, p)).cast("int")))), " ")

    def planned(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        return F.struct(w.alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))

    words = let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, let(planned(w), repeated)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.when(F.pmod(h, F.lit(10)) == 0, words).otherwise(F.col("text")).alias("text"))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import documents
    found = periodic_runs(with_planted_repeats(documents(spark, sf_dir)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"),
                                                              r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "text", best.alias("b")).select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))



def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of the SQL expression ``text``, bit by bit."""
    digits = "'0123456789ABCDEF'"
    byte = (f"16 * (strpos({digits}, substr(hex({text}), 2 * crc_i + 1, 1)) - 1) "
            f"+ strpos({digits}, substr(hex({text}), 2 * crc_i + 2, 1)) - 1")
    steps = f"flatten(list_transform(range(strlen({text})), lambda crc_i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {steps}), lambda crc_c, crc_x: CASE WHEN crc_x >= 0 "
            "THEN xor(crc_c, crc_x) WHEN crc_c % 2 = 1 THEN xor(crc_c // 2, 3988292384) ELSE crc_c // 2 END))")


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
m AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
        CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
t AS (SELECT rid, n, unnest(w) AS x, unnest(range(n)) AS i FROM m),
g AS (SELECT rid, n, w[i + 1] || chr(10) || w[i + 2] || chr(10) || w[i + 3] || chr(10) || w[i + 4] || chr(10) || w[i + 5] AS k, i
      FROM (SELECT rid, n, w, unnest(range(n - 4)) AS i FROM m)),
e AS (SELECT b.rid, c.i - b.i AS q, b.i FROM g b JOIN g c ON b.rid = c.rid AND b.k = c.k AND c.i > b.i
      WHERE 4 * (c.i - b.i) <= b.n),
s AS (SELECT rid, q, min(i) AS s, count(*) + 4 + q AS l
      FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS o FROM e) GROUP BY rid, q, o),
r AS (SELECT rid, s, l, min(q) AS q FROM s WHERE l >= greatest(6, 4 * q) GROUP BY rid, s, l),
f AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
             min(struct_pack(l := -l, s := s, q := q)) AS b FROM r GROUP BY rid),
o AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM r),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS kept FROM t ANTI JOIN o USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start,
       CAST(-b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(-1000 * b.l // b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)
"""
