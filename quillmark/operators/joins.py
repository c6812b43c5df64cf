"""Join helpers: size-checked broadcast with a salted fallback, co-location.

Broadcasting is only safe for a side whose size is *known*. These helpers
measure the candidate side first (one small aggregation job) and fall back
to a shuffle join that salts the hot keys when it is over the bound, so a join
on a handful of hot keys never lands in a handful of tasks and a side over the
bound never reaches the driver.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.session import cut_lineage

# Bounds for a broadcast side (rows and estimated bytes).
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Replicas of a hot key's rows of the small side in the salted fallback, and the share
# of the big side's rows from which a key is replicated: at most 1 / SALT_SHARE keys.
DEFAULT_SALT = 64
SALT_SHARE = 1e-3
# A key that holds at least this share of the rows is "hot"; there are at most
# 1 / HOT_SHARE of them, so what is broadcast for them has a proven bound.
HOT_SHARE = 1e-4
# Keys that one task's sketch counts. Its error is 3.5 / SKETCH_KEYS of the rows
# at most, less than HOT_SHARE.
SKETCH_KEYS = 1 << 17


def estimated_size(df: DataFrame) -> tuple[int, int]:
    """``(rows, bytes)`` of a DataFrame, bytes estimated from its columns."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.aggregate(F.col(f.name), F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(
                F.octet_length(x), F.lit(0))), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(F.col(f.name)), F.lit(0)) * 8)
        else:
            parts.append(F.lit(8))
    width = sum(parts[1:], parts[0]) if parts else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    rows, size = estimated_size(df)
    return rows <= max_rows and size <= max_bytes


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salt: int = DEFAULT_SALT, salt_by: list[str] | None = None) -> DataFrame:
    """Shuffle join that spreads the hot keys of the big side over ``salt`` tasks each.

    Keys that hold ``SALT_SHARE`` of the big side's rows are found by a sketch
    (:func:`hot_hashes`). Only their rows get a deterministic salt from a hash of
    ``salt_by`` (re-computable after executor loss, unlike ``rand()``), and only
    their rows of the small side are replicated. Spark must not broadcast: it takes
    the size of the small side from its compressed files, and would not count the
    replicas, so a table of any size could be sent through the driver.
    """
    # Hashes of equal keys are equal only within one type; else every key is salted.
    one_type = all(big.schema[k].dataType == small.schema[k].dataType for k in on)
    hot = pa.array([], pa.int64()) if salt == 1 else hot_hashes(big, on, SALT_SHARE) if one_type else None
    if hot is not None and not len(hot):
        return big.join(small.hint("merge"), on, how)
    none, spread = F.lit(0).cast("long"), F.pmod(F.xxhash64(*[F.col(c) for c in salt_by or big.columns]), F.lit(salt))
    every = F.sequence(none, F.lit(salt - 1).cast("long"))
    if hot is None:
        b, s = big.withColumn("_salt", spread), small.withColumn("_salt", F.explode(every))
    else:
        named = F.broadcast(big.sparkSession.createDataFrame(pa.table({"_h": hot})).withColumn("_hit", F.lit(True)))
        b, s = (df.withColumn("_h", F.xxhash64(*on)).join(named, "_h", "left").drop("_h") for df in (big, small))
        b = b.withColumn("_salt", F.when(F.col("_hit"), spread).otherwise(none)).drop("_hit")
        s = s.withColumn("_salt", F.explode(F.when(F.col("_hit"), every).otherwise(F.array(none)))).drop("_hit")
    return b.join(s.hint("merge"), on + ["_salt"], how).drop("_salt")


def sized_broadcast_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                         max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES,
                         salt: int = DEFAULT_SALT, salt_by: list[str] | None = None) -> DataFrame:
    """Broadcast ``small`` if its measured size is under the bound, else shuffle (:func:`salted_join`)."""
    if fits_broadcast(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt, salt_by)


def co_locate(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """Hash-partition by ``key`` once so every later per-key aggregation and
    join on ``key`` runs without another exchange."""
    return df.repartition(key)


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``(once, repeated)``: the rows whose ``key`` no other row has, and the others
    (None where there are none); a null key is a value like others.

    One job over the keys alone. What is a function of one row can be computed where
    the rows of ``once`` stand; keys are unique as a rule, so few rows or none have to meet.
    """
    again = cut_lineage(df.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
    if again.isEmpty():
        return df, None
    if fits_broadcast(again):
        again = F.broadcast(again)
    same = df[key].eqNullSafe(again["_again"])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def probe_sample(df: DataFrame) -> DataFrame:
    """A sixteenth of the rows, the same in every run, for ``split_lookup``'s
    ``probe`` where making the rows to look up is dear. It decides only what
    is matched map-side, never a result."""
    return df.sample(fraction=1 / 16, seed=16)


def hot_hashes(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> pa.Array:
    """The 64-bit hash of every key that holds at least ``share`` of ``rows``.

    A mergeable frequency sketch over the rows themselves (one pass, one row
    out), so a key is found hot by what is looked up, whatever the table holds.
    At most ``1 / share`` hashes reach the driver.
    """
    k = math.ceil(1 / share)
    row = rows.select(F.xxhash64(*keys).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {k}, {max(SKETCH_KEYS, 2 * k)})").alias("top")).first()
    least = max(2.0, row["n"] * share)
    return pa.array([r["item"] for r in row["top"] or [] if r["count"] >= least], pa.int64())


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """``_h``: the hashes of :func:`hot_hashes`."""
    return rows.sparkSession.createDataFrame(pa.table({"_h": hot_hashes(rows, keys, share)}))


def split_lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str],
                 share: float = HOT_SHARE, probe: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined to ``table`` (unique on ``keys``), with hot keys split
    off — for lookups where one key (a frequent word, bigram or id) may hold a
    large share of ``rows``.

    Hot keys are found by a sketch over the rows (:func:`hot_keys`; ``probe``:
    over these instead, a sample of them say). Their part of the table is
    broadcast — at most ``1 / share`` rows — and matched map-side. Rows with a
    hot key, found in the table or not, go through the shuffle join with the
    rest under a null key and a hash of their own, which spreads them evenly.
    Same result as a plain left join, whatever the sketch finds.
    """
    hot = hot_keys(rows if probe is None else probe, keys, share)
    named = table.select(*keys, *values, F.xxhash64(*keys).alias("_h"))
    few = named.join(F.broadcast(hot), "_h", "left_semi").drop("_h")
    # 0 in every row, but no literal: Spark would take a literal out of the join's keys.
    rest = named.join(F.broadcast(hot), "_h", "left_anti").withColumn("_s", F.pmod("_h", F.lit(1))).drop("_h")
    few = few.select(*keys, *[F.col(v).alias(f"_h_{v}") for v in values])
    # Bounded by 1 / share rows.
    j = (rows.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(hot.withColumn("_hit", F.lit(True))), "_h", "left")
         .drop("_h").join(F.broadcast(few), keys, "left"))
    hit = F.col("_hit").isNotNull()
    j = j.select("*", F.when(hit, F.xxhash64(*rows.columns)).otherwise(F.lit(0)).alias("_s"),
                 *[F.when(~hit, F.col(k)).alias(f"_k_{k}") for k in keys])
    rest = rest.select("_s", *[F.col(k).alias(f"_k_{k}") for k in keys], *values)
    out = j.join(rest, ["_s", *[f"_k_{k}" for k in keys]], "left")
    return out.select(*rows.columns, *[F.when(hit, F.col(f"_h_{v}")).otherwise(F.col(v)).alias(v) for v in values])
