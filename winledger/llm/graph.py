"""Connected components by alternating stars, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winledger.llm.shared import cut


def _fold(pairs: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("_least")).select(
        F.col("u").alias("_node"), F.least("u", "_least").alias("_least"))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_fold(both), F.col("u") == F.col("_node")).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("_least").alias("v")).distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every pair runs from the larger node to the smaller."""
    linked = pairs.join(_fold(pairs), F.col("u") == F.col("_node"))
    return (linked.select(F.when(F.col("v") == F.col("_least"), F.col("u")).otherwise(F.col("v")).alias("u"),
                          F.col("_least").alias("v"))
            .where("u != v").distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for every node with a link.

    Pairs with a null end and loops are left out. Each round rewrites the pairs as stars around the least
    neighbour, on both sides, until a round changes nothing; the number of rounds grows with the logarithm
    of the longest path. A node with very many neighbours is combined by partial minima and, in the join
    back, split by the skew handling of sort-merge joins.
    """
    pairs = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    pairs = cut(pairs)
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        pairs = cut(_small_star(_large_star(pairs)))
