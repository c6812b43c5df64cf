"""Distributed global ordering: row index / cumulative weight over a total order.

``row_number() OVER (ORDER BY ...)`` without a partition moves every row
into one task. Here the rows are range-partitioned on the order key,
sorted inside each partition, and written once to the shared checkpoint
folder (so both passes below see the same partitions, also after an
executor loss). Each partition's total is then a tiny table — one row per
partition, a size known before it is built — that is broadcast back as
offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import cut_lineage


def global_position(df: DataFrame, order: list[Column], weight: str | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Add ``_start``: the total ``weight`` (or row count) of all rows that
    come strictly before this row in ``order``.

    ``order`` must be a strict total order for a deterministic result (add a
    unique tie-breaker).
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    # Without an explicit count AQE sizes the range partitions to the data.
    ranged = (df.withColumn("_w", w).repartitionByRange(partitions, *order) if partitions
              else df.withColumn("_w", w).repartitionByRange(*order))
    srt = (ranged
             .sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    srt = cut_lineage(srt)
    in_part = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = srt.withColumn("_local", F.sum("_w").over(in_part) - F.col("_w"))
    sizes = srt.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    # One row per partition: bounded by the partition count, safe to broadcast.
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_tot").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    return out.withColumn("_start", F.col("_off") + F.col("_local")).drop(
        "_pid", "_mid", "_local", "_off", "_w")
