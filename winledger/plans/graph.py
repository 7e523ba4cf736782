"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winledger.plans.ordered import held


def _least(pairs: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours."""
    return pairs.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("_least")).withColumn(
        "_least", F.least("_node", "_least"))


def _round(pairs: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the node itself, is tied to the least of them.

    Pairs run both ways. A node with very many neighbours is combined by partial minima; the join back is left to
    the skew split.
    """
    tied = pairs.join(_least(pairs), F.col("a") == F.col("_node")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    own = _least(pairs).select(F.col("_node").alias("a"), F.col("_least").alias("b"))
    new = tied.unionByName(own).where("a != b").distinct()
    return new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for every end of an edge.

    Each round halves the distances to the least node of a component, until every node is tied to it alone. Loops
    give their node; edges with a null end are left out. Rounds are written to the checkpoint folder.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select("a").unionByName(ends.select(F.col("b").alias("a"))).distinct()
    pairs = ends.where("a != b")
    pairs = held(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        pairs = held(_round(pairs))
    roots = _least(pairs)
    return nodes.join(roots, F.col("a") == F.col("_node"), "left").select(
        F.col("a").alias("node"), F.coalesce("_least", "a").alias("root"))
