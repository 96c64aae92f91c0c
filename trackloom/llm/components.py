"""Connected components by large-star and small-star rounds; links stay distributed throughout.

Each round hangs neighbours under the smallest node in sight, so chains shorten by a constant factor; it ends when every
node hangs directly under one that hangs under none: the smallest of its component. Nulls and loops in links are left out; repeated links count
once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.state import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours hang under its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "star")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, itself and its smaller neighbours hang under the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("least")), "star")
    under = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return under.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node that hangs under none; rounds keep what is connected, so these are it."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inner = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return twice.select("a").unionByName(inner).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b): comp is the smallest node that it reaches."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct(), "edges")
    while not _stars(edges):
        edges = cut(_small_star(cut(_large_star(edges), "edges")), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
