"""Connected components by alternating stars: every round is two aggregations over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b. Large: each node hands its larger neighbours its least one; small: its smaller ones.

    The neighbours of a node aren't gathered: its least one is aggregated and joined back.
    """
    both = links.select("a", "b")
    if large:
        both = both.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("n"), F.least("a", "least").alias("least"))
    joined = both.join(least, both.a == least.n)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component is the least node reachable.

    Rounds go on until the links are stars, about the logarithm of the longest path; each is written to the
    shared folder, so a lost executor costs one round.
    """
    now = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        # stars: no centre is a leaf, and no leaf has two centres
        centres = now.select(F.col("b").alias("a")).distinct()
        if now.join(centres, "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select(F.col("a").alias("node"), F.col("a").alias("component")))
        now = cut(_star(_star(now, True), False))
