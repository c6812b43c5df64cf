"""Tokenised pair tables, corpus vocabulary and id encoding

Scale design: a pair's texts are shuffled **once** by ``pair_id``
(:func:`tokenised_pairs`). Every later per-pair explode, group-by and join
on ``pair_id`` then runs inside that partitioning without another
exchange — the exploded n-grams, which are many times the text size, never
cross the network. ``pair_id`` is unique per pair, so this exchange cannot
be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators.joins import probe_sample, split_lookup
from quillmark.operators.ranking import global_position

# Fixed ids of the encoded form.
PAD_ID = 0
UNK_ID = 1
FIRST_TOKEN_ID = 2
LABEL_IGNORE = -100


def tokenised_pairs(pairs: DataFrame, tokenizer=tx.tok, key: str = "pair_id",
                    sides=("gold", "predicted"), extra: tuple[str, ...] = ()) -> DataFrame:
    """``(key, g, h, *extra)``: token arrays of the two sides, co-located by key."""
    g, h = sides
    return pairs.select(key, tokenizer(g).alias("g"), tokenizer(h).alias("h"),
                        *extra).repartition(key)


def side_tokens(tp: DataFrame, key: str = "pair_id") -> DataFrame:
    """Long form ``(key, side, pos, token)`` of a :func:`tokenised_pairs` frame
    (side 0 = gold, 1 = predicted; ``pos`` from 0). Stays in the key's partitioning."""
    both = tp.select(key, F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("g").alias("toks")),
        F.struct(F.lit(1).alias("side"), F.col("h").alias("toks")))))
    return both.select(key, "side", F.posexplode("toks").alias("pos", "token"))


def texts_tokens(df: DataFrame, text_cols: list[str], tokenizer=tx.tok) -> DataFrame:
    """All tokens of some text columns as one column ``token``."""
    arr = F.flatten(F.array(*[tokenizer(c) for c in text_cols])) if len(text_cols) > 1 \
        else tokenizer(text_cols[0])
    return df.select(F.explode(arr).alias("token"))


def build_vocab(df: DataFrame, text_cols: list[str], tokenizer=tx.tok) -> DataFrame:
    """PRJ-8: corpus vocabulary ``(token, count, rank, id)``.

    ``rank`` orders tokens by (count desc, token) from 0; ``id = rank + 2``
    (0 pad, 1 unknown). Counting is a partial aggregation; the global rank
    runs on the distinct-token table only, range-partitioned (no
    single-task window).
    """
    counts = texts_tokens(df, text_cols, tokenizer).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"))
    ranked = global_position(counts, [F.col("count").desc(), F.col("token").asc()])
    return ranked.select("token", "count", F.col("_start").alias("rank"),
                         (F.col("_start") + FIRST_TOKEN_ID).alias("id"))


def encode_columns(df: DataFrame, key: str, vocab: DataFrame, cols: dict[str, tuple[str, int | None]]) -> DataFrame:
    """``(key, <out>...)``: token ids in token order of several text columns,
    ``cols`` naming each output's column and length (None: whole).

    One pass over all columns and one lookup. Positions beyond a length are
    cut before tokens are exploded, so no more is looked up or gathered than
    the result holds. Unknown tokens have id 1.
    """
    def part(n: int, col: str, length: int | None) -> Column:
        toks = tx.tok(col) if length is None else F.slice(tx.tok(col), 1, length)
        return F.struct(F.lit(n).alias("_side"), toks.alias("_toks"))

    def tokens(rows: DataFrame) -> DataFrame:
        sides = rows.select(key, F.inline(F.array(*[part(n, *c) for n, c in enumerate(cols.values())])))
        return sides.select(key, "_side", F.posexplode("_toks").alias("pos", "token"))

    # The vocabulary grows with the corpus, so it is shuffle-joined on the
    # token, with the tokens that are hot in these texts matched map-side.
    j = split_lookup(tokens(df), vocab.select("token", "id"), ["token"], ["id"], probe=tokens(probe_sample(df)))
    item = F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).cast("int").alias("id"))
    # One sort for all sides: positions within, sides by filter.
    ids = j.groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col("_side") == n, item))).alias(f"_{out}")
                               for n, out in enumerate(cols)])
    return df.select(key).join(ids, key, "left").select(key, *[
        F.coalesce(F.transform(f"_{out}", lambda s: s["id"]), F.array().cast("array<int>")).alias(out) for out in cols])


def encode(df: DataFrame, key: str, col: str, vocab: DataFrame) -> DataFrame:
    """``(key, ids)``: token ids of the whole text ``col`` in token order; unknown -> 1."""
    return encode_columns(df, key, vocab, {"ids": (col, None)})


def truncate_pad(ids: Column, length: int) -> Column:
    """Cut an id array to ``length`` and pad it with ``PAD_ID`` to exactly ``length``."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def pad_to_multiple(ids: Column, length: int) -> Column:
    """Pad an id array with ``PAD_ID`` to the next multiple of ``length``, cutting nothing."""
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.pmod(-F.size(ids), F.lit(length))))


def encode_truncate_pad(df: DataFrame, vocab: DataFrame, key: str = "pair_id",
                        source: str = "gold", target: str = "predicted",
                        max_source: int = 64, max_target: int = 32) -> DataFrame:
    """PRJ-9: ``input_ids`` / ``labels`` as fixed-length id arrays."""
    ids = encode_columns(df, key, vocab, {"input_ids": (source, max_source), "labels": (target, max_target)})
    return ids.select(key, truncate_pad(F.col("input_ids"), max_source).alias("input_ids"),
                      truncate_pad(F.col("labels"), max_target).alias("labels"))


def attention_masks(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """PRJ-10: ``attention_mask`` (1 token / 0 pad) and ``global_attention_mask``
    (1 at position 0 only, on every row)."""
    return df.withColumn("attention_mask", F.transform(ids, lambda x: (x != PAD_ID).cast("int"))) \
             .withColumn("global_attention_mask",
                         F.transform(ids, lambda x, i: (i == 0).cast("int")))


def mask_labels(df: DataFrame, col: str = "labels") -> DataFrame:
    """PRJ-11: pad ids in labels become -100 (ignored by a loss)."""
    return df.withColumn(col, F.transform(col, lambda x: F.when(x == PAD_ID, F.lit(LABEL_IGNORE)).otherwise(x)))


def unmask_labels(df: DataFrame, col: str = "labels") -> DataFrame:
    """PRJ-11 inverse: -100 back to the pad id before decoding."""
    return df.withColumn(col, F.transform(col, lambda x: F.when(x == LABEL_IGNORE, F.lit(PAD_ID)).otherwise(x)))


def decode_columns(df: DataFrame, vocab: DataFrame, cols: dict[str, str], key: str = "pair_id") -> DataFrame:
    """``(key, <out>...)``: the texts of several id arrays (``cols``: output -> id
    column), special ids (pad, unknown, -100) skipped; one lookup for all, hot
    ids matched map-side."""
    def ids(rows: DataFrame) -> DataFrame:
        sides = rows.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("_side"), F.col(c).alias("_ids"))
                                                    for n, c in enumerate(cols.values())])))
        return sides.select(key, "_side", F.posexplode("_ids").alias("pos", "id")).where(F.col("id") >= FIRST_TOKEN_ID)

    j = split_lookup(ids(df), vocab.select(F.col("id").cast("int").alias("id"), "token"), ["id"], ["token"],
                     probe=ids(probe_sample(df)))
    item = F.struct("pos", "token")
    g = j.where(F.col("token").isNotNull()).groupBy(key).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("_side") == n, item))).alias(f"_{out}") for n, out in enumerate(cols)])
    return df.select(key).join(g, key, "left").select(key, *[
        F.coalesce(F.array_join(F.transform(f"_{out}", lambda s: s["token"]), " "), F.lit("")).alias(out) for out in cols])


def decode_ids(df: DataFrame, vocab: DataFrame, key: str = "pair_id", col: str = "input_ids",
               out: str = "decoded") -> DataFrame:
    """PRJ-12: ids back to text, special ids (pad, unknown, -100) skipped."""
    return decode_columns(df, vocab, {out: col}, key)


def gen_len(df: DataFrame, col: str = "labels", by: str | None = None) -> DataFrame:
    """AGG-2: mean count of non-pad ids per row."""
    n = F.size(F.filter(col, lambda x: (x != PAD_ID) & (x != LABEL_IGNORE)))
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(F.avg(n).alias("gen_len"))
