"""Connected components of an edge table, without collecting edges or vertices anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


class UnionFind:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def forest(edges: DataFrame, a: str = "a", b: str = "b", batch_rows: int = 1 << 17) -> DataFrame:
    """A forest with the components of `edges`: each batch of a partition gives (member, root) edges only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shrink() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x, y = t.column(0).to_numpy(), t.column(1).to_numpy()
            ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            u = UnionFind(len(ids))
            for i, j in zip(at[: len(x)].tolist(), at[len(x) :].tolist(), strict=True):
                u.union(i, j)
            roots = u.roots()
            moved = np.flatnonzero(roots != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= batch_rows:
                yield shrink()
                held, rows = [], 0
        if held:
            yield shrink()

    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of `edges`(a, b): the smallest id of its component.

    Each round hooks every vertex to its smallest neighbour or itself, jumps pointers once, and
    contracts; vertices without an edge left are done. A round at least halves what is left of a
    component, near enough, so rounds grow with the logarithm of its size. Sums before shuffles
    (`min`) keep hubs from meeting in one task.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("up")))
        up = hook.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        jump = materialise(hook.join(up, "up").select("id", F.col("upper").alias("to")))
        if labels is None:
            labels = jump.select("id", F.col("to").alias("component"))
        else:
            step = jump.select(F.col("id").alias("component"), "to")
            labels = materialise(labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        left, right = jump.select(F.col("id").alias("a"), F.col("to").alias("x")), jump.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        edges = materialise(forest(moved.distinct()).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # A contraction may leave a root that is not the smallest member.
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))
