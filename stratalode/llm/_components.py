"""Connected components of a graph of links, by alternating stars.

Edges are first joined inside each partition of the table, up to ``MANY`` nodes at a
time, so few links between partitions are left to travel. Then each round makes every node point to the smallest
node it sees: first its larger neighbours do (large star), then its smaller ones (small
star). The number of edges never grows, whatever the degrees, and after few rounds each
component is a star around its smallest node. Rounds end in written tables, so a lost
executor costs tasks and not the loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.llm._shared import dropped, written

#: Nodes that a task holds at a time.
MANY = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition -> (node, smallest node it is joined to in the partition)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for y in path:
            root[y] = x
        return x

    def joined() -> pa.RecordBatch:
        ends = [(x, find(x)) for x in [*root]]
        ends = [e for e in ends if e[0] != e[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if len(root) > MANY:
            yield joined()
    yield joined()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b -> the same after one star step."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = seen.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = seen.join(least, "a")
    if large:
        new = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.filter("a > b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node that has
    an edge. Null ends and loops are left out; direction and repeats don't matter."""
    now = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a > b")
    last: list[DataFrame] = []
    while True:
        now = written(now.mapInArrow(_forest, "a long, b long"), "edges", narrow=True)
        dropped(*last)
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
        # done when every node points up once at most, and those pointed to nowhere
        if not seen.filter("up > 1 OR (up > 0 AND low = 0)").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
        large = written(_star(now, True), "edges", narrow=True)
        last, now = [now, large], _star(large, False)
