"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation over the edges; nothing is collected.  Each round's edges are
written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours, and for small-star itself, to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        linked = both.join(least, both["a"] == least["node"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        joined = down.join(least, down["a"] == least["node"])
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the least node that it is connected to."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges-0")
    before, k = None, 0
    while True:
        k += 1
        now = written(_star(_star(now, True), False), folder, f"edges-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
