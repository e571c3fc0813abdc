"""Connected components of a table of links, by alternating large-star and small-star steps.

Links, labels and components stay distributed; each step is a partial aggregate and a join on the node,
whose result is written to the shared folder, so the lineage stays short and lost executors cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter(F.col("a") > F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select("m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable), for every node of the links (a, b) with a < b.

    Links with a = b add nothing. Ends when no node has two smaller neighbours and no root is itself linked
    to something smaller: a property of the links, not a number of rounds.
    """
    now = freeze(links, "links")
    while True:
        heads = now.groupBy("b").agg(F.count("*").alias("n"))
        open_ends = heads.filter("n > 1").select("b").unionAll(now.join(heads.select(F.col("b").alias("a")), "a", "left_semi").select("a"))
        if open_ends.isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
        now = freeze(_small_star(_large_star(now)), "links")
