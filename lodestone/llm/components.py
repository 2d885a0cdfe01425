"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the least neighbour; the number of rounds grows with
the logarithm of the longest path. Links stay a distributed table throughout: hubs are
met with partial aggregates and with joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import cut, release


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the greater end ``a`` to the lesser ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node points to one node, which points to none."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: any order, repeats allowed); component is the least node reachable."""
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(_small_star(now), label)
    while not _is_forest_of_stars(now):
        old, now = now, cut(_small_star(_large_star(now)), label)
        release(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
