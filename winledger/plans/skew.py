"""Joins in which one key may hold much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winledger.plans.ordered import SLICE_ROWS


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], count: str = "_n") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``count`` how many rows of ``left`` have it.

    A key with more than ``spark.winledger.sliceRows`` rows is heavy: its rows are dealt by the hash of ``row`` over as
    many parts as it has slices, and its right row is repeated for each. There are no more heavy keys than the table
    has slices, so the list of them is broadcast; all other keys are joined plainly. NULL keys match nothing."""
    every = int(left.sparkSession.conf.get("spark.winledger.sliceRows", str(SLICE_ROWS)))
    parts = F.ceil(F.col(count) / every).cast("int")
    heavy = right.filter(F.col(count) > every).select(*[F.col(k).alias(f"_h_{k}") for k in keys], parts.alias("_parts"))
    dealt = left.join(F.broadcast(heavy), [F.col(k) == F.col(f"_h_{k}") for k in keys], "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*row), F.col("_parts"))).cast("int")).drop(
        "_parts", *[f"_h_{k}" for k in keys])
    others = [c for c in right.columns if c not in (*keys, count)]
    copies = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *others,
                          F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("_copy"))
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_salt") == F.col("_copy")]
    return dealt.join(copies, same).drop("_salt", "_copy", *[f"_r_{k}" for k in keys])
