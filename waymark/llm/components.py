"""Connected components of a link table by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """links: u > v. The table of least neighbours is written, so both sides of the join are plain scans: Spark broadcasts
    the table while it's small, and splits the links of a hub over tasks when it isn't."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    return links.join(least, links.v == least.a).select("u", F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ordered.groupBy("u").agg(F.min("v").alias("m"))
    moved = ordered.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) of every node u that isn't its component's smallest node v. links: (u, v) bigint, in any order.

    Each round is written to the shared folder. The rounds end when one leaves the links as they were; their number
    grows with the logarithm of the largest component's size.
    """
    links = written(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    said = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == said or now[0] == 0:
            return links
        said = now
