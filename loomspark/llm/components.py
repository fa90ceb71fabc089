"""Connected components of an edge table by alternating star contractions (large star, small
star): every round is a few joins and aggregations, so no component meets in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import by_sorting, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Up to so many edges are broadcast.
FEW_EDGES = 100_000


def _large_star(edges: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = near.filter("b > a").join(joined(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _small_star(edges: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(joined(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, root for every node of an edge; root is the smallest
    node of its component."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (now := (row[0], row[1])) == mark or not row[0]:
            break
        mark = now
        joined = F.broadcast if row[0] <= FEW_EDGES else by_sorting
        edges = materialize(_small_star(_large_star(edges, joined), joined), "cc")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
