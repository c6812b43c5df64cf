"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key in [0, 1). Within each source the
documents are ordered by that key, their word counts are summed as
distributed prefix sums, and the source's budget is cut exactly: whole
epochs first, then the documents before the cut, the one across it in part.

The range sort and prefix sums take two levels. The key range is divided in
equal ranges; the key is uniform, so the ranges of a source hold about as
many rows each however large the source is (a hot source has no hot task).
Sums per range give each range's offset, a window inside the range does the
rest. Nothing is collected and no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.tables import fresh, named_rows, staged

#: The separator of words: space and the five ASCII controls 0x09-0x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a source per range of the key, on average.
ROWS_PER_RANGE = 4096
#: The key has this many hex digits; ranges are cut on the first 7.
KEY_HEX, RANGE_HEX = 16, 7
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Words of a text (0 where null): separators between non-empty parts."""
    n = F.size(F.split(text, SPACES))
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    tail = F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(
        n - lead - tail).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of all sources from ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn and share the
    total of all sizes; a target stops at ``max_epochs`` times its source's
    size and the excess is shared again by weight until none is above. That
    fixed point is ``min(cap, level * weight)``: in the order of cap / weight
    the capped sources come first, so one ordered pass over the source
    *aggregate* (one row per source) finds the level.
    """
    # md5 and friends aside, Spark orders strings by UTF-8 bytes, which is code point order.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (s.withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
          .withColumn("_w_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
          .withColumn("_total", F.sum("source_size").over(every).cast("double")))
    level = (F.col("_total") - F.col("_cap_before")) / F.col("_w_left")
    # Not capped from the first source on whose cap is not below its share.
    s = s.withColumn("_level", F.min(F.when(F.col("_cap") >= level * F.col("_w"),
                                            F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(),
                                                     F.col("source"), level.alias("level")))).over(every))
    target = F.least(F.col("_cap"), F.col("_level.level") * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = 0, ties: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row.

    The columns ``ties`` follow in the order, and are returned as well.

    ``taken`` is the number of words the mix takes from the row: ``epochs``
    times its size, plus what of it lies before the cut of the last, partial
    epoch. The taken words of a source add up to its target rounded down, and
    never pass ``max_epochs`` times a row's size. The order depends on
    ``doc_id``, ``size``, ``seed`` and ``ties`` only, so reruns agree.

    Null text counts 0 words and takes 0. Null or repeated ids are rows of
    their own: rows equal in (source, key, doc_id, size) are interchangeable,
    so the rows returned are the same whichever comes first. An empty table
    gives no rows. Other columns are not read.
    """
    slim = staged(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                   F.lit(f":{seed}"))), 1, KEY_HEX).alias("_key"), *ties), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_epochs)
    targets = targets.join(sizes.select(F.col("source").alias("_s"), "_n"),
                           F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # One row per source; carries the budget and the number of key ranges.
    targets = staged(targets.select(
        F.col("source").alias("_src"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
         .cast("long").alias("_epochs"),
        F.ceil(F.col("_n") / ROWS_PER_RANGE).cast("long").alias("_ranges")), "mix-targets")
    at = F.conv(F.substring("_key", 1, RANGE_HEX), 16, 10).cast("long")
    rows = slim.join(targets, F.col("source").eqNullSafe(F.col("_src"))).withColumn(
        "_range", F.floor(at * F.col("_ranges") / F.lit(16 ** RANGE_HEX)).cast("long"))
    cells = rows.groupBy("_src", "_range").agg(F.sum("size").alias("_in_range"))
    offsets = cells.withColumn("_offset", F.coalesce(F.sum("_in_range").over(
        Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).select(F.col("_src").alias("_osrc"), F.col("_range").alias("_orange"), "_offset")
    inside = (Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "size", *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("_src").eqNullSafe(F.col("_osrc"))
                     & (F.col("_range") == F.col("_orange")))
    rest = F.floor(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_offset") - F.col("_before")))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"), *ties)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS,
                    max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as the mix takes them.

    A row taken for whole epochs appears that many times; the row across a
    source's cut appears once more with its leading words (joined by one
    space, ``n_chars`` counted anew) so that the budget is met to the word.
    Documents without words are in no budget and pass once. Rows not taken go.
    Rows that share an id, or have none, are rows of their own: the mix comes
    back to each by a row name of its own. Ties in the mix's order go by a hash of the
    row's columns, so that the cut doesn't depend on where rows stand.
    """
    key, size, taken, words = (fresh(docs, c) for c in ("mix_row", "mix_size", "mix_taken", "mix_words"))
    named, row, content = named_rows(docs)
    mixed = mix(named, weights, max_epochs, seed, (content, row)).select(
        F.col(row).alias(key), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = named.join(mixed, F.col(row) == F.col(key))
    whole = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.floor(F.col(taken) / F.col(size)))
    part = F.when(F.col(size) == 0, F.lit(0)).otherwise(F.col(taken) % F.col(size))
    copies = F.concat(F.array_repeat(F.col(size), whole.cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn(words, F.explode(copies))
    lead = F.array_join(F.slice(F.array_remove(F.split("text", SPACES), ""), 1,
                                F.greatest(F.col(words), F.lit(0)).cast("int")), " ")
    cut = F.col(words) < F.col(size)
    out = {"text": F.when(cut, lead).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(lead).cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import documents
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 16) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
             CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0.0) AS cap_before,
             (SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0.0) AS w_left,
             (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) AS total,
             row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS rk
      FROM w WINDOW p AS (ORDER BY cap / w, source ASC NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min((total - cap_before) / w_left, rk) AS level FROM o
       WHERE cap >= (total - cap_before) / w_left * w),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM lv) * w) AS target FROM o),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0,
            CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
