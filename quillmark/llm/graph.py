"""Distributed connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.tables import staged

#: Nodes that one task's union-find holds before it hands out its forest.
LOCAL_NODES = 200_000


class UnionFind:
    """Sets of numbers, each named by its smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> Iterable[tuple[int, int]]:
        """(number, name of its set) of all but the names."""
        return [(x, self.find(x)) for x in list(self.up)]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()

    def out():
        pairs = np.array(sets.forest(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                sets.union(a, b)
        if len(sets.up) >= LOCAL_NODES:
            yield out()
            sets = UnionFind()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that an
    edge (two long columns, any order, repeats and loops allowed) joins to a
    smaller one; nodes not returned are their own component.

    Each task first shrinks its edges to a forest by union-find. Rounds of
    large-star and small-star (each node's larger, then smaller neighbours
    are hung on its smallest) turn the forests into stars; every round is
    written once, and the only values that reach the driver are the count and
    checksum that tell when nothing changes.
    """
    a, b = edges.columns
    now = staged(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                 .mapInArrow(_forest, "a long, b long").distinct(), "forest")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Never broadcast: the files are far smaller than their rows in the driver's memory.
        large = both.where(F.col("b") > F.col("a")).join(least.hint("merge"), "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        small = (small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = staged(small, "stars")
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
