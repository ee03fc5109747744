"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import store


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one root and no root is a node itself."""
    several = edges.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").select("u")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return several.unionByName(inner).isEmpty()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not the smallest of its component.

    Each step sends a node's links to its smallest neighbour; rounds go with the logarithm of the
    size. Neighbourhoods are only aggregated, never gathered; a hot node's links are split by the join.
    After a given number of ``rounds`` nodes of a component may still have several roots, all in it:
    enough for who only wants to leave out pairs that are known to be linked.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    edges = store(edges.distinct(), "edges")
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.distinct(), "edges")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        turn += 1
        if turn == rounds:
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
