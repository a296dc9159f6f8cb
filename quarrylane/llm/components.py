"""Connected components of a link table by alternating star operations.

Each round keeps the components and shortens the paths: first every node hands
the smallest node it knows to its larger neighbours, then to its smaller ones.
Both are a grouped minimum and a join, so a node with millions of links costs
partial minima and a skew join, never a list in one task. Rounds end in the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import materialize


def _clean(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _clean(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return _clean(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, component), component being the smallest node that is reachable.

    Only nodes with a link to another node have a row. Nulls take no part; repeated links, either way
    round, and links of a node to itself change nothing; without links the result is empty.
    """
    now = materialize(_clean(links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
        now = materialize(_small_star(_large_star(now)), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
