"""Connected components of a table of links, by alternating large and small stars.

In each round every node links its larger neighbours to its smallest neighbour, then its smaller ones. All steps are joins
and sums by node, so a node with very many links is summed map-side first; nothing is collected but the number of links
that changed. Rounds grow with the logarithm of the longest chain. Every round is written, so a lost executor costs no more
than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; the root is the smallest node reachable."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    while True:
        large = _star(edges, larger=True)
        small = written(_star(large, larger=False), "links")
        state = _state(small)
        if state == _state(edges):
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u > v). Large star: the larger neighbours of a node go to the smallest of it and its neighbours. Small star:
    the smaller neighbours, and the node itself, go to the smallest."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        return moved.select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    kept = least.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(kept).distinct()
