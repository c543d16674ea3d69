"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import stored


def _are_stars(links: DataFrame) -> bool:
    """Does every b hang on one a, and no a on another?"""
    ends = links.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs > 1 or hangs + holds > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest number that each node of ``links`` (a, b) is joined to.

    Large-star and small-star steps, stored in pairs: every step hangs the neighbours of a node on its smallest one,
    until all links are stars. A node's neighbours are only summed up, never gathered; the number of steps grows with
    the logarithm of the longest path.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = stored(links)
    while not _are_stars(links):
        # Large star: a node's larger neighbours hang on its smallest one, or on itself.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
        links = stored(small.where("a <> b").distinct())
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
