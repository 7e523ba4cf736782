"""Streaming: the silence timer and late data."""

import datetime as dt

from pyspark.sql import functions as F

from winledger.session import SETTINGS
from winledger.streaming import flows, stateful

ROCKS = "spark.sql.streaming.stateStore.providerClass"
T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches, build):
    """Write batches as files in order, one per micro-batch, and run to the end."""
    spark.conf.set(ROCKS, SETTINGS[ROCKS])
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/in/b{i}")
    schema = batches[0].schema
    out = None
    for i in range(len(batches)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b[0-{i}]")
        out = build(stream)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def guard_rows(spark, rows):
    return spark.createDataFrame(
        [("x", s, i, float(ts), "assistant", 1, 0, 0.0, "", "", "", False) for i, (s, ts) in enumerate(rows)],
        "tenant_id string, session_id string, event_id long, ts double, kind string, out_tokens long, "
        "thinking_tokens long, cost_usd double, text string, tool string, tool_args string, progress boolean")


def test_silence_timer(spark, tmp_path):
    base = T0.timestamp()
    got = feed(spark, str(tmp_path), [guard_rows(spark, [("a", base), ("b", base)]),
                                      guard_rows(spark, [("b", base + 100), ("b", base + 1000)])],
               lambda s: stateful.stream_stalls(s, {"silence_s": 120.0}))
    silent = [r for r in got if r["event_id"] is None]
    assert [(r["session_id"], r["state"]) for r in silent if r["session_id"] == "a"] == [("a", "stalled")]


def test_late_rows_are_dropped(spark, tmp_path):
    def tasks(minutes):
        return spark.createDataFrame(
            [("m", "c", T0 + dt.timedelta(minutes=m), True, "measured") for m in minutes],
            "model_id string, cluster_id string, ts_start timestamp, succeeded boolean, verification_grade string")

    got = feed(spark, str(tmp_path), [tasks([5, 10]), tasks([300]), tasks([20, 301])],
               lambda s: flows.stream_windows(s, width="1 hour", lateness="1 hour"))
    assert [(r["ts"], r["n"]) for r in got] == [(T0, 2)]


def test_long_session_of_attempts(spark, tmp_path):
    """A hundred thousand attempts wait in one session; each is read when it is due."""
    n = F.col("id")
    start = F.timestamp_seconds(F.lit(int(T0.timestamp())) + n + F.floor(n / 10) * 300)

    def attempts(ids):
        return ids.select(
            F.lit("x").alias("tenant_id"), F.lit("s").alias("session_id"), F.lpad(n.cast("string"), 9, "0").alias("trace_id"),
            start.alias("ts_start"), start.alias("ts_end"), F.struct(F.lit("t").alias("system_prompt_fingerprint")).alias("input_shape"),
            F.lit("m").alias("model_id"), F.struct(F.when(n % 10 == 9, "pass").otherwise("fail").alias("status")).alias("verification"),
            F.lit("0.5").cast("decimal(20,9)").alias("cost_usd"), F.struct(F.lit(7).cast("long").alias("total_ms")).alias("latency"),
            F.lit(None).cast("array<string>").alias("input_shingles"))

    got = feed(spark, str(tmp_path), [attempts(spark.range(100_000)), attempts(spark.range(200_000, 200_001))],
               lambda s: stateful.stream_tasks(s))
    assert len(got) == 10_000
    assert {(r["attempts"], r["succeeded"], r["first_attempt_success"], float(r["total_cost_usd"]), r["total_wall_ms"])
            for r in got} == {(10, True, False, 5.0, 70)}
    assert sorted(int(r["task_id"]) for r in got) == list(range(0, 100_000, 10))
