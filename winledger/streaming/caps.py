"""Spend caps over a stream: every micro-batch is judged by the batch operator, from what was spent before it.

What was spent is a table by session and by tenant and day: a micro-batch adds the sums it changed as a folder of
its own, and every ``KEEP`` batches the folders are folded into one without sessions and days that are long past. A
retried batch overwrites its folders, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.operators.caps import MONEY, stopped_caps
from winledger.plans.ordered import held

KEEP = 16
FORGET_DAYS = 7
"""Days after which a silent session or a past day is forgotten."""
SPENT = f"tenant_id string, session_id string, day long, spent {MONEY}, seen double"


def _before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """What had been spent before a batch: the last folded table and the folders after it."""
    base = batch_id // KEEP * KEEP
    paths = [f"{folder}/until={base}"] * (base > 0) + [f"{folder}/batch={k}" for k in range(base, batch_id)]
    rows = spark.read.schema(SPENT).parquet(*paths) if paths else spark.createDataFrame([], SPENT)
    return rows.groupBy("tenant_id", "session_id", "day").agg(F.max("spent").alias("spent"), F.max("seen").alias("seen"))


def _fold(spark: SparkSession, folder: str, batch_id: int, forget_days: int) -> None:
    """The sums before a batch as one table, from the table and the folders before."""
    start = batch_id - KEEP
    paths = [f"{folder}/until={start}"] * (start > 0) + [f"{folder}/batch={k}" for k in range(start, batch_id)]
    rows = held(spark.read.schema(SPENT).parquet(*paths).groupBy("tenant_id", "session_id", "day").agg(
        F.max("spent").alias("spent"), F.max("seen").alias("seen")))
    newest = rows.agg(F.max("seen")).first()[0]
    if newest is not None:
        rows = rows.where(F.col("seen") >= newest - forget_days * 86_400.0)
    rows.write.mode("overwrite").parquet(f"{folder}/until={batch_id}")


def stream_caps(events: DataFrame, path: str, checkpoint: str, policy: Mapping | None = None, *,
                forget_days: int = FORGET_DAYS, **trigger):
    """Start a query that writes the rows of ``operators.caps.stopped_caps`` for a stream of events, micro-batch by
    micro-batch in order of arrival. A session that is silent for ``forget_days`` begins anew."""
    folder = f"{checkpoint}/spent"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % KEEP == 0:
            _fold(spark, folder, batch_id, forget_days)
        spent = held(_before(spark, folder, batch_id))
        told = held(stopped_caps(batch, policy, sessions=spent.where("day IS NULL"), days=spent.where("day IS NOT NULL")))
        told.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        by_session = told.groupBy("tenant_id", "session_id").agg(F.max("session_spent").alias("spent"), F.max("ts").alias("seen"))
        by_day = told.groupBy("tenant_id", "day").agg(F.max("day_spent").alias("spent"), F.max("ts").alias("seen"))
        by_session.withColumn("day", F.lit(None).cast("long")).unionByName(
            by_day.withColumn("session_id", F.lit(None).cast("string"))).write.mode("overwrite").parquet(
            f"{folder}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
