"""Connected components by alternating large and small stars (Kiveris et al., 2014), in DataFrame functions.

Links stay distributed; the driver sees one answer a round, whether all links form stars by now, and rounds grow with
the logarithm of a component's length. Each round is written, so a lost executor costs that round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), with a > b unless large. Links neighbours of each node to the smallest among them and the node."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b), a > b, has one smaller neighbour or only larger ones: then b is a's smallest node."""
    sides = [edges.select(F.col(c).alias("node"), F.lit(own).alias("below")) for c, own in (("a", 1), ("b", 0))]
    node = sides[0].unionByName(sides[1]).groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return node.where("below > 1 or below = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long), materialised. Returns rep, grp: each linked node with the smallest node of its component."""
    edges = links.where("a <> b")
    while True:
        before, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        drop(before)  # the links themselves stay
        if _all_stars(edges):
            break
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("grp")).unionByName(edges.select(F.col("b").alias("rep"), F.col("b").alias("grp")).distinct())
