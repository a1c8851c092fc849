"""Connected components of a graph of links, by large and small stars.

Each round connects every node's larger neighbours to the smallest node it
sees (large star), and then its smaller ones (small star); it ends when no edge
changes.  Every step is a partial aggregate and a join, which AQE splits at
nodes with many links; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v) with u > v, or both ways for the large star."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
    if small:
        out = linked.select("a", "b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.where("a > u").select("a", "b")
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root), root the smallest node of its component."""
    edges = common.stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before, edges = edges, common.stored(_star(_star(both, False), True), "links")
        common.discard(before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
