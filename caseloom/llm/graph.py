"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table

HELD = 500_000  # nodes that a task joins up at a time


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _local(parts):
    """A star around the smallest node of each component that the edges of one task make."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [(x, r) for x, r in pairs if x != r]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield stars()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in `edges` (a, b: long); the root is the smallest node it can reach.

    Each task first joins up its own edges. Then large and small stars alternate until every node has one edge, to a
    node that has none to a smaller one. Edges stay in the cluster; the driver sees two counts a round. Written to the
    shared folder each round, so no lineage builds up.
    """
    now = written_table(edges.select("a", "b").mapInArrow(_local, "a long, b long"), "edges")
    while True:
        now = written_table(_small_star(_large_star(now)), "edges")
        children = now.groupBy("a").agg(F.count("*").alias("n"))
        if not children.filter("n > 1").select("a").unionByName(now.join(children.select(F.col("a").alias("child")), F.col("b") == F.col("child"), "left_semi").select("a")).head(1):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
