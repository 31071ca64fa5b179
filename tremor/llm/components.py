"""Connected components of an edge table by alternating large and small stars, written after each round; a small rest is solved inside one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import Shelf

#: Edges up to which a task solves what is left: a few megabytes there, and no further rounds over all tasks. Larger tables go on in rounds.
EDGES = 100_000


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u, or u itself; partial minima first, so a hot node is no hot task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _solved(batches):
    """(node, root) of all edges (u, v) in the batches, by union of the smaller roots."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, a: str, b: str, shelf: Shelf | None = None) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component. Ids are longs.

    Only the last round's edges are kept, on shelf as "edges"; the caller deletes them once it has read the result.
    """
    shelf = shelf or Shelf(edges.sparkSession)
    e = shelf.put("edges", edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"))
    if e.count() > EDGES:
        e = shelf.put("edges", e.distinct())
    while True:
        if e.count() <= EDGES:
            return e.coalesce(1).mapInArrow(_solved, "node long, root long")
        # done once no end of an edge is the start of another, and each start has one edge
        chained = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        forked = e.groupBy("u").count().filter("count > 1").select("u")
        if chained.union(forked).isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = shelf.put("edges", small)
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
