"""Connected components on executors: large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of integers in any order, repeated or not, self-loops ignored, nulls ignored.

    Returns (node, component) for each node that has an edge; component is the smallest node reachable.
    """
    e = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    while before[0]:
        # large star: every larger neighbour of a node is hung on the node's smallest neighbour (or itself)
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of these
        e = common.written(e)
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        near = e.join(low, "a")
        e = common.written(near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
