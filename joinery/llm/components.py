"""Connected components of links by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link what a node is linked with to the least of it: its larger neighbours, or its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and the least node that it is connected with, of all nodes of links (a, b).

    Rounds go on until nothing changes (about the square of the logarithm of the longest chain); every round is written to the
    shared folder, and the one before is removed.  A hot node's neighbours are
    first reduced to their least by partial aggregation; the join back is
    one row against many, which adaptive execution splits.
    """
    edges = common.materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, now = None, mark(edges)
    while now != before:
        stars = common.materialise(_star(_star(edges, True), False), "stars")
        before, now = now, mark(stars)
        common.drop(edges)
        edges = stars
    # settled: every edge leads from a node to its component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
