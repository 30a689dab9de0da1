"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b), component being its smallest reachable node.

    Edges become stars around the smallest node in a number of rounds that
    grows with the logarithm of the longest path; each round is cut by a
    checkpoint. A node's neighbours are never collected. An empty table gives
    no rows; loops and repeated edges change nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = checkpointed(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # only neighbours above a node move to its smallest one, and only if that is another than the node
        low = both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a").select(F.col("a").alias("b"), "m")
        large = e.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
