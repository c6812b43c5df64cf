"""Embedding near-dedup: random-hyperplane hashing, exact cosine, components.

Vectors equal byte for byte are one class with a count. In each of several
tables a class's bucket is the signs of its products with random hyperplanes;
classes that share a bucket meet in a task, which computes the exact cosines
in double precision and hands out link counts and a union-find forest, never
the pairs. A pair that meets in several tables counts in the first.

Bits a table grow with the logarithm of the classes, so a bucket of unrelated
vectors stays small, and the tables follow from the recall wanted for a pair
exactly at the threshold (pairs above it are found more often). A bucket with
more than ``BLOCK`` classes is dealt in blocks of that size to one task for
each pair of blocks: nothing is left out and no task holds the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import mix64
from quillmark.llm.blocks import block_pairs, group_tables
from quillmark.llm.graph import UnionFind, components
from quillmark.llm.tables import staged, table

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold meets in some table.
RECALL = 0.98
#: Unrelated classes a bucket holds on average, about.
PER_BUCKET = 8
BLOCK = 1024
SEED = 20240229


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and number of tables for ``n`` classes."""
    bits = min(30, max(6, round(math.log2(max(2, n) / PER_BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers (rows by tables) of the vectors."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _usable(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose vector can be compared, and their components as bytes of doubles or floats."""
    rows, out = [], []
    width = np.float64 if pa.types.is_floating(column.type.value_type) and column.type.value_type == pa.float64() else np.float32
    values = column.values
    valid = np.ones(len(values), bool) if not values.null_count else np.asarray(values.is_valid())
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(width) + width(0)   # -0 becomes 0
    offsets = column.offsets.to_numpy()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(there):
        a, b = offsets[i], offsets[i + 1]
        x = flat[a:b]
        if valid[a:b].all() and np.isfinite(x).all() and x.any():
            rows.append(i)
            out.append(x.tobytes())
    return np.array(rows, np.int64), out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [None] * batch.num_rows
        named = batch.column(0).is_valid()
        for i, k in zip(*_usable(batch.column(1)), strict=True):
            keys[i] = k if named[int(i)].as_py() else None
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])


def _unit(keys: list[bytes], width) -> np.ndarray:
    x = np.frombuffer(b"".join(keys), width).reshape(len(keys), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)   # neither squares of huge nor of tiny components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def find_links(classes: DataFrame, n: int, width: type = np.float32,
               threshold: float = THRESHOLD) -> DataFrame:
    """``rep, links, parent`` from classes ``(rep, mult, key)``: per task and
    class, how many vectors of other classes it found linked, and a class of
    the same component that is smaller (null where it is the smallest)."""
    bits, tables = plan(n, threshold)
    size = np.dtype(width).itemsize

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_pylist()
            dims = np.array([len(k) // size for k in keys])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c = codes(_unit([keys[i] for i in at], width), bits, tables)
                own = batch.take(pa.array(at))
                for t in range(tables):
                    where = mix64(c[:, t].astype(np.uint64) + np.uint64((int(dim) << 48) + (t << 32))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where), pa.array(np.full(len(at), t, np.int32)), *own.columns],
                        names=["bucket", "t", "rep", "mult", "key"])

    rows = classes.select("rep", "mult", "key").mapInArrow(
        spread, "bucket long, t int, rep long, mult long, key binary")
    rows = block_pairs(rows, "bucket", "rep", BLOCK)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(part: pa.Table):
            b, rep, mult = (part[c].to_numpy() for c in ("b", "rep", "mult"))
            i, j, t = part["i"][0].as_py(), part["j"][0].as_py(), part["t"][0].as_py()
            x = _unit(part["key"].to_pylist(), width)
            if i == j:
                p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
                p, q = np.nonzero(x[left] @ x[right].T >= threshold)
                p, q = left[p], right[q]
            if t and len(p):
                own = codes(x, bits, tables)[:, :t]
                new = np.ones(len(p), bool)
                for k in range(t):
                    new &= own[p, k] != own[q, k]
                p, q = p[new], q[new]
            if not len(p):
                return None
            links = np.bincount(p, mult[q], len(rep)) + np.bincount(q, mult[p], len(rep))
            sets = UnionFind()
            for a, c in zip(rep[p].tolist(), rep[q].tolist(), strict=True):
                sets.union(a, c)
            at = np.flatnonzero(links)
            parent = [r if (r := sets.find(a)) != a else None for a in rep[at].tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(rep[at]), pa.array(links[at].astype(np.int64)), pa.array(parent, pa.int64())],
                names=["rep", "links", "parent"])

        for part in group_tables(batches, ("bucket", "i", "j")):
            if part.num_rows > 1 and (out := group(part)) is not None:
                yield out

    return rows.mapInArrow(linked, "rep long, links long, parent long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``
    (``vec_id`` long, ``embedding`` array of floats or doubles).

    A vector that is null, empty, zero, or holds a null or non-finite
    component links with nothing, nor do rows without an id: no links, a component
    of its own (null and kept without an id). Vectors of different lengths don't
    link. Equal vectors (rows repeated or not) are linked to each other; all their rows are returned. Scores of exactly the
    threshold link. An empty table gives no rows; other columns are not read.
    """
    width = np.float64 if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else np.float32
    keyed = staged(vectors.select("vec_id", "embedding").mapInArrow(_keyed, "vec_id long, key binary"), "vectors")
    # A row without an id has no key: it takes no part.
    classes = staged(keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "classes")
    found = staged(find_links(classes, classes.count(), width), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    stars = components(found.where(F.col("parent").isNotNull()).select("rep", "parent"))
    of_class = (classes.join(links, "rep", "left").join(stars, F.col("rep") == F.col("node"), "left")
                .select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    out = keyed.join(of_class, "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      own.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op9_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
