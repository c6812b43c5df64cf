"""Spelling variants: near words by a dictionary of trie-node pairs.

Words are the leaves of two tries, of the words and of the words reversed. A
trie node is numbered by the sorted words themselves: in ranges of sorted
words, a prefix that the word before doesn't have opens a node. A place in a
word is then a pair of numbers, the node of what stands before and the node of
what stands after. Two words differ in one replaced code point if they have
the same pair around a skipped place, and in one inserted code point if a pair
around a skipped place of the longer is a pair around a cut of the shorter.
Nodes stand for whole strings, so the integer join is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.runs import crc32_sql
from quillmark.llm.tables import staged
from quillmark.operators.joins import sized_broadcast_join
from quillmark.operators.ranking import global_position

# Fixed values of words and variants.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 6, 5, 5
DROP_EVERY = 199
#: Node numbers of one range of words; its highest half is for nodes that reach its end.
RANGE_BITS = 36
#: Words of one range.
RANGE_WORDS = 50_000

SKIP, LAST_SKIP, CUT = 0, 1, 2


def damaged(doc_id, word):
    """``word`` of a document, without one of its code points where the crc32 of both says so."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word).cast("bigint")).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(h, F.lit(DROP_EVERY)) == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """``word, n`` of the words of ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences or more.

    Words are runs of ``LETTERS``, A-Z lower-cased; ``change(doc_id, word)``
    may rewrite each. Counted within the tasks before words are exchanged, so
    a word in every document is one row a task.
    """
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(
        F.translate(F.col("text"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("word"))
    # A changed word is shorter, never longer.
    words = words.where(F.length("word") >= MIN_LENGTH)
    if change:
        words = words.select(change(F.col("doc_id"), F.col("word")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _common(a: str, b: str) -> int:
    """Code points that two words begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while a[lo] == b[lo]:
        lo += 1
    return lo


def _open_ranges(ends: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """Per range its last word and, for every prefix of that, the range in
    which the prefix begins (ranges in order; ``ends`` are first and last words)."""
    out: list[tuple[str, list[int]]] = []
    for k, (first, last) in enumerate(ends):
        # A prefix of all words of the range may come from the one before.
        shared = min(_common(first, last), _common(out[-1][0], last)) if out else -1
        own = out[-1][1][:shared + 1] if out else []
        out.append((last, own + [k] * (len(last) + 1 - len(own))))
    return out


def _node_numbers(numbers: list[int], reach: list[tuple[str, list[int]]]):
    """Numbers of all prefixes of the words of a range, from batches ``range, id, w`` sorted by ``w``.

    A prefix of the range's last word is numbered by the range it begins in
    and its length; any other lies within one range and is numbered there.
    """
    place = {pid: k for k, pid in enumerate(numbers)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, nodes, fresh, k = None, "", [], 0, 0
        for batch in batches:
            ids, values, sizes = [], [], []
            for pid, wid, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pid != now:
                    now, k, before, nodes, fresh = pid, place[pid], "", [], 0
                last, starts = reach[k]
                back_last, back_starts = reach[k - 1] if k else ("", [])
                same = _common(before, word) if nodes else -1
                ahead = _common(word, last)
                behind = _common(word, back_last) if k else -1
                nodes = nodes[:same + 1]
                for depth in range(len(nodes), len(word) + 1):
                    if depth <= ahead:
                        nodes.append(starts[depth] << RANGE_BITS | 1 << RANGE_BITS - 1 | depth)
                    elif depth <= behind:
                        nodes.append(back_starts[depth] << RANGE_BITS | 1 << RANGE_BITS - 1 | depth)
                    else:
                        nodes.append(k << RANGE_BITS | fresh)
                        fresh += 1
                before = word
                ids.append(wid)
                values.append(np.array(nodes, np.int64))
                sizes.append(len(nodes))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(
                    np.append(0, np.cumsum(sizes)).astype(np.int32), np.concatenate(values))], names=["id", "nodes"])
    return run


def trie_nodes(words: DataFrame, name: str) -> DataFrame:
    """``id, <name>``: for every ``id, w`` the numbers of the trie nodes of all
    prefixes of ``w`` (the empty one first). Equal prefixes, and only those,
    have equal numbers.

    Only the first and last word of each range of sorted words reach the
    driver, to settle prefixes that run over the ranges' borders.
    """
    count = words.count()
    parts = max(1, math.ceil(count / RANGE_WORDS))
    ranged = staged(words.repartitionByRange(parts, "w").sortWithinPartitions("w").select(
        F.spark_partition_id().alias("range"), "id", "w"), "sorted-words")
    ends = ranged.groupBy("range").agg(F.min("w").alias("a"), F.max("w").alias("b")).collect()
    ends.sort(key=lambda r: r["range"])
    # Files are read whole and in order only range by range: sorted again where they are read.
    rows = ranged.repartition(parts, "range").sortWithinPartitions("range", "w")
    return rows.mapInArrow(
        _node_numbers([r["range"] for r in ends], _open_ranges([(r["a"], r["b"]) for r in ends])),
        "id bigint, nodes array<bigint>").withColumnRenamed("nodes", name)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node pairs around each skipped and each cut place of ``id, w, before, after`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            out = []
            for wid, word, before, after in zip(*(c.to_pylist() for c in batch.slice(lo, 2000).columns), strict=True):
                n, pre, suf = len(word), np.array(before), np.array(after[::-1])
                # Of equal neighbours only the last is skipped towards shorter words.
                kind = np.array([SKIP if a == b else LAST_SKIP for a, b in zip(word, word[1:] + "\0", strict=True)])
                out.append((pre[:-1], suf[1:], np.full(n, wid), kind))
                out.append((pre, suf, np.full(n + 1, wid), np.full(n + 1, CUT)))
            if out:
                p, s, i, kind = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, s, i * 4 + kind)], names=["p", "s", "m"])


def near_counts(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words of ``id, word`` each word is near to
    (one code point inserted, deleted or replaced) and the smallest id of those;
    words that are near to none have no row.

    The words that meet at one pair of nodes differ in the code point skipped
    there, so there are at most as many as letters, and one that has none.
    Each gets its count and its best from the group's two best; no pair of
    words is made.
    """
    pre = trie_nodes(words.select("id", F.col("word").alias("w")), "before")
    suf = trie_nodes(words.select("id", F.reverse("word").alias("w")), "after")
    both = words.select("id", "word").join(pre.hint("merge"), "id").join(suf.hint("merge"), "id").select(
        "id", "word", "before", "after")
    pairs = both.mapInArrow(_pairs, "p bigint, s bigint, m bigint")
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list("m")).alias("m")).where(F.size("m") > 1)

    def ids(kinds):
        return F.transform(F.filter("m", lambda x: (x % 4).isin(*kinds)), lambda x: F.shiftright(x, 2))

    met = met.select(ids([SKIP, LAST_SKIP]).alias("skips"), ids([LAST_SKIP]).alias("longer"), ids([CUT]).alias("cut"))
    short = F.get("cut", F.lit(0))
    of_skips = F.transform("skips", lambda x: F.struct(
        x.alias("id"),
        (F.size("skips") - 1 + F.when(F.array_contains("longer", x), F.size("cut")).otherwise(0)).alias("n"),
        F.least(F.when(x == F.get("skips", F.lit(0)), F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0))),
                F.when(F.array_contains("longer", x), short)).alias("best")))
    of_cut = F.transform("cut", lambda x: F.struct(
        x.alias("id"), F.size("longer").alias("n"), F.get("longer", F.lit(0)).alias("best")))
    each = met.select(F.explode(F.concat(of_skips, of_cut)).alias("e")).select("e.*").where(F.col("n") > 0)
    return each.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(counts: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``.

    ``form`` is the near word of largest n (ties: smallest in code-point
    order) if that is at least ``MIN_RATIO`` times the word's, else null;
    ``root`` follows forms to the last. Counts grow ``MIN_RATIO``-fold along
    the way, so pointers double to the end in a few rounds. Words are unique;
    an empty table gives no rows.
    """
    # Numbered by rank, so that the best of some words is the smallest number.
    counts = staged(counts.select("word", "n"), "word-counts")
    ranked = staged(global_position(counts, [F.col("n").desc(), F.col("word")])
                    .withColumnRenamed("_start", "id"), "ranked-words")
    near = staged(near_counts(ranked), "near-words")
    # As many rows as words on either side: never broadcast, however small Spark takes their files to be.
    named = ranked.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = near.join(named.hint("merge"), "best")
    out = staged(ranked.join(found.hint("merge"), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("form_n") >= MIN_RATIO * F.col("n"), F.col(c)).alias(c) for c in ("best", "form", "form_n")]),
        "word-forms")
    link = out.where(F.col("best").isNotNull()).select("id", F.col("best").alias("to"))
    while True:
        onward = link.select(F.col("id").alias("to"), F.col("to").alias("next"))
        link = staged(sized_broadcast_join(link, onward, ["to"], "left", salt_by=["id"]).select(
            "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        if not link.where("moved").limit(1).count():
            break
        link = link.select("id", "to")
    roots = ranked.select(F.col("id").alias("to"), F.col("word").alias("root"))
    roots = link.select("id", "to").join(roots.hint("merge"), "to").select("id", "root")
    return out.join(roots.hint("merge"), "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import documents
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return spelling_variants(word_counts(docs, damaged))


OP12_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}')) AS w
        FROM documents) GROUP BY doc_id, w HAVING length(w) >= {MIN_LENGTH}),
h AS (SELECT w, n, CASE WHEN doc_id IS NOT NULL THEN {crc32_sql("k")} END AS h FROM (SELECT *, coalesce(doc_id || ':' || w, '') AS k FROM t)),
d AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2)
             ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(w) >= {MIN_LENGTH} GROUP BY w HAVING sum(n) >= {MIN_COUNT}),
p AS (SELECT w, substr(w, 1, i) || '*' || substr(w, i + 2) AS star, substr(w, 1, i) || substr(w, i + 2) AS short
      FROM (SELECT w, unnest(range(length(w))) AS i FROM v)),
e AS (SELECT a.w, b.w AS x FROM p a JOIN p b USING (star) WHERE a.w <> b.w
      UNION SELECT p.w, v.w FROM p JOIN v ON p.short = v.w
      UNION SELECT v.w, p.w FROM p JOIN v ON p.short = v.w),
g AS (SELECT e.w, count(*) AS n_near, min(struct_pack(n := -v.n, w := v.w)) AS b
      FROM e JOIN v ON e.x = v.w GROUP BY e.w),
f AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN -b.n >= {MIN_RATIO} * v.n THEN b.w END AS form, CASE WHEN -b.n >= {MIN_RATIO} * v.n THEN -b.n END AS form_n
      FROM v LEFT JOIN g ON v.w = g.w),
r AS (SELECT word, word AS root, form AS next FROM f
      UNION ALL SELECT r.word, r.next, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN r ON f.word = r.word AND r.next IS NULL
"""
