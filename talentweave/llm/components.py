"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself: larger ones, or else smaller ones."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = pairs.join(low, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges(a, b)``; a component's name is its smallest node.

    Loops and repeated edges are harmless; no edge, no row. The rounds end when the edges are stars around the smallest
    nodes and no longer change.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        large = _star(both, large=True).where("a <> b").distinct()
        now = cut_lineage(_star(large.toDF("u", "v"), large=False).where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.toDF("node", "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state
