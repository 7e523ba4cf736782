"""Spend caps against calls judged one after the other."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from winledger.operators import caps
from winledger.streaming import caps as live

SCHEMA = "tenant_id string, session_id string, event_id long, ts double, cost_usd decimal(14,6)"
POLICY = {"session_budget_usd": 2.0, "daily_budget_usd": 5.0, "action": "stop"}


def calls(seed, n=900, tenants=2, sessions=25, days=12):
    rng = random.Random(seed)
    return [(f"t{rng.randrange(tenants)}", f"s{rng.randrange(sessions)}", i, round(rng.uniform(0, days * 86_400), 3),
             Decimal(rng.randrange(0, 8000)) / 10_000) for i in range(n)]


def judged(batches, policy):
    """(event, verdict, cap, session spend, day spend) of each call, in order of arrival."""
    session, day, out = {}, {}, []

    def cap(s, d):
        if policy["session_budget_usd"] and s >= policy["session_budget_usd"]:
            return "session budget"
        return "daily budget" if policy["daily_budget_usd"] and d >= policy["daily_budget_usd"] else ""

    for batch in batches:
        for tenant, sid, i, ts, cost in sorted(batch, key=lambda r: (r[3], r[2])):
            s, d = (tenant, sid), (tenant, int(ts // 86_400))
            before = cap(session.get(s, 0), day.get(d, 0))
            if before and policy["action"] == "stop":
                out.append((i, "refused", before, session.get(s, 0), day.get(d, 0)))
                continue
            session[s], day[d] = session.get(s, 0) + cost, day.get(d, 0) + cost
            after = cap(session[s], day[d])
            out.append((i, "alert" if after else "ok", after, session[s], day[d]))
    return sorted(out)


def got(df):
    return sorted((r["event_id"], r["verdict"], r["cap"], r["session_spent"], r["day_spent"]) for r in df.collect())


@pytest.mark.parametrize("change", [{}, {"action": "alert"}, {"daily_budget_usd": 0.0}, {"session_budget_usd": 0.0}])
def test_batch(spark, change):
    rows, policy = calls(1), {**POLICY, **change}
    want = judged([rows], policy)
    assert got(caps.stopped_caps(spark.createDataFrame(rows, SCHEMA), policy)) == want
    if policy["action"] == "stop":
        assert sum(r[1] == "refused" for r in want) > 100


def test_one_tenant_is_cut(sliced):
    """All rows in one tenant, and most in one session, in slices of twenty."""
    rows = [(t, "s0" if i % 3 else s, i, ts, c / 50) for t, s, i, ts, c in calls(2, tenants=1, days=40)]
    placed = caps.scan(sliced.createDataFrame(rows, SCHEMA).withColumn("day", F.lit(0)), ["tenant_id"], ["ts", "event_id"],
                       running_sum={"x": F.col("cost_usd")})
    assert placed.count() == len(rows)
    assert got(caps.stopped_caps(sliced.createDataFrame(rows, SCHEMA), POLICY)) == judged([rows], POLICY)


def test_days_change_each_other(spark):
    """A day's cut leaves a session more for the next day, whose cut moves, and so on."""
    rows = [("t", f"s{k % 4}", 10 * d + k, d * 86_400.0 + k, Decimal("0.7")) for d in range(8) for k in range(9)]
    policy = {"session_budget_usd": 5.0, "daily_budget_usd": 2.5, "action": "stop"}
    assert got(caps.stopped_caps(spark.createDataFrame(rows, SCHEMA), policy)) == judged([rows], policy)


def test_nulls_and_nothing(spark):
    rows = [("t", "s", 1, 5.0, None), ("t", "s", 2, 5.0, Decimal(3)), ("t", "s", 3, 5.0, Decimal(1))]
    assert [r[1] for r in got(caps.stopped_caps(spark.createDataFrame(rows, SCHEMA), POLICY))] == ["ok", "alert", "refused"]
    assert caps.stopped_caps(spark.createDataFrame([], SCHEMA), POLICY).count() == 0


def test_stream_equals_arrival(spark, tmp_path, monkeypatch):
    """Micro-batches in order of arrival, with the spend table folded twice on the way; a second start goes on."""
    monkeypatch.setattr(live, "KEEP", 3)
    batches = [calls(10 + k, n=120, days=4) for k in range(8)]
    batches = [[(t, s, 1000 * k + i, ts, c / 4) for t, s, i, ts, c in b] for k, b in enumerate(batches)]
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for half in (batches[:5], batches[5:]):
        for b in half:
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        live.stream_caps(events, out, ckpt, POLICY, availableNow=True).awaitTermination()
    arrived = [{r["event_id"] for r in spark.read.parquet(f"{out}/batch={k}").collect()} for k in range(8)]
    by_id = {r[2]: r for b in batches for r in b}
    want = judged([[by_id[i] for i in ids] for ids in arrived], POLICY)
    assert got(spark.read.parquet(out)) == want and sum(r[1] == "refused" for r in want) > 50


def test_forgotten(spark, tmp_path, monkeypatch):
    """What is long past leaves the folded table."""
    monkeypatch.setattr(live, "KEEP", 2)
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k in range(5):
        spark.createDataFrame([("t", f"s{k}", k, k * 10 * 86_400.0, Decimal(1))], SCHEMA).coalesce(1).write.mode(
            "append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        live.stream_caps(events, out, ckpt, POLICY, availableNow=True).awaitTermination()
    kept = spark.read.parquet(f"{ckpt}/spent/until=4").where("session_id IS NOT NULL").collect()
    assert [r["session_id"] for r in kept] == ["s3"]
