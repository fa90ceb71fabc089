"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.frames import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. node, root for every node of an edge; root is the smallest node reachable.
    Every round takes the smallest root among neighbours and then the root's own root, so ways
    shorten by half; a round is two joins, whatever the size of a component."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    at = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = at.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        low = written(low, "roots")
        jump = low.select(F.col("node").alias("to"), F.col("to").alias("over"))
        moved = written(low.join(jump, "to").select("node", F.col("over").alias("root"), (F.col("over") < F.col("was")).alias("moved")), "roots")
        at = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return at
