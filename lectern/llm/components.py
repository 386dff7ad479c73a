"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import saved


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint), root the smallest node of its component.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest node around it;
    the number of rounds grows with the logarithm of a component's size. A round is two aggregations that
    combine before the shuffle and two joins whose large side can be split, so a star of any size uses many
    tasks. The driver sees a count and a checksum a round. Links of a node to itself and links with a null
    are left out; an empty table has no nodes.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") == F.col("b")).alias("self"))
    pairs = saved(pairs.filter(~F.col("self")).select("a", "b").distinct(), "links")
    before = None
    while before != (mark := _mark(pairs)):
        before = mark
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        pairs = saved(small.distinct(), "links")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
