"""Groups of rows dealt to tasks in blocks, and read back group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import mix64
from quillmark.llm.tables import staged
from quillmark.operators.joins import sized_broadcast_join


def group_tables(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows equal in ``keys``, from batches in which they lie together."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        whole = pa.Table.from_batches(held).combine_chunks()
        new = np.ones(whole.num_rows, bool)
        new[1:] = np.any([(k := whole[c].to_numpy())[1:] != k[:-1] for c in keys], axis=0)
        at = np.append(np.flatnonzero(new), whole.num_rows)
        for a, b in zip(at[:-1] if last else at[:-2], at[1:], strict=False):
            yield whole.slice(a, b - a)
        held[:] = [] if last else whole.slice(at[-2]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from cut(False)
    if held:
        yield from cut(True)


def block_pairs(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """``rows`` dealt to ``key, i, j``: the rows of a key in blocks (``b``) of
    about ``block`` rows by a hash of ``member``, each pair of blocks i <= j
    together once. A key with at most ``block`` rows is one block. Sorted, so
    that ``group_tables`` can read them."""
    big = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    rows = sized_broadcast_join(rows, staged(big, "big"), [key], "left", salt_by=[member])
    n = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    rows = (rows.withColumn("_blocks", n)
                .withColumn("b", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
                .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
                .withColumn("i", F.least("b", "_o")).withColumn("j", F.greatest("b", "_o"))
                .drop("_n", "_blocks", "_o"))
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", member)


def span_batches(doc, rid, lo, hi, parts: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Ranges by document (and name of its text), joined where they touch or
    overlap, as pairs of 32-bit numbers; dealt over ``parts``. ``names`` are
    the columns of the part and of the other kind of row (null here)."""
    if not len(doc):
        return
    order = np.lexsort((lo, rid, doc))
    doc, rid, lo, hi = doc[order], rid[order], lo[order], hi[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]))
    first = np.flatnonzero(new)
    # Far apart by document, so that one running maximum serves all.
    far = (np.cumsum(new) - 1) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + far)
    cut = np.append(True, (lo[1:] + far[1:] > reach[:-1]) | new[1:])
    at = np.flatnonzero(cut)
    pairs = np.stack([lo[at], reach[np.append(at[1:], len(lo)) - 1] - far[at]], 1).astype(np.int32)
    bounds = np.append(np.searchsorted(at, first), len(at))
    yield pa.RecordBatch.from_arrays(
        [pa.array((mix64(rid[first].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)),
         pa.nulls(len(first), pa.binary()), pa.array(doc[first]), pa.array(rid[first]),
         pa.array([pairs[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())],
        names=[*names, "doc_id", "rid", "spans"])
