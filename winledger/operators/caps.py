"""Spend caps that refuse calls.

A refused call costs nothing, so what is left of a cap depends on what was refused before. Inside a day that
settles itself in running sums: of a session's calls those are let through that come before its cap is reached, and
of these all that come before the day's cap is reached. Only what a session brings into a day depends on earlier
days, so the days are gone over again until no session brings anything else; each time at least one more day of a
tenant is settled, and only days that got other sums are looked at again. Keys are cut by ``plans.ordered``, so a
tenant that holds all rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.operators.guard import EVENT_ORDER, POLICY_DEFAULTS, SESSION, cap_hit, policy_columns
from winledger.plans.ordered import held, scan

MONEY = "decimal(28,9)"
DAY = ["tenant_id", "day"]
SESSION_DAY = [*SESSION, "day"]


def utc_day(ts: Column) -> Column:
    return F.floor(ts.cast("double") / 86_400).cast("long")


def _same(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(k) == F.col(f"{prefix}{k}") for k in keys]


def _named(df: DataFrame, keys: list[str], prefix: str, **columns: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[F.col(c).alias(n) for n, c in columns.items()])


def _with(df: DataFrame, other: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """``df`` with columns of ``other`` by ``keys``; money that is missing there is 0."""
    found = df.join(_named(other, keys, "_k_", **columns), _same(keys, "_k_"), "left").drop(*[f"_k_{k}" for k in keys])
    return found.withColumns({n: F.coalesce(n, F.lit(0).cast(MONEY)) for n in columns})


def _carried(got: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """What each session brings into each of its days. A session has one row for a day."""
    earlier = Window.partitionBy(*SESSION).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rows = got.withColumn("carry", F.coalesce(F.sum("got").over(earlier), F.lit(0)).cast(MONEY))
    if sessions is None:
        return rows.select(*SESSION_DAY, "carry")
    return _with(rows, sessions, SESSION, _spent="spent").select(
        *SESSION_DAY, (F.col("carry") + F.col("_spent")).cast(MONEY).alias("carry"))


def _let_through(placed: DataFrame, carry: DataFrame, days: DataFrame | None, p: Mapping[str, Column]) -> DataFrame:
    """Events with ``carry``, ``started`` (spent on the day before all events), ``take`` (the cost if the session's cap
    lets it through), ``day_upto`` (its running sum) and ``ok``."""
    session_cap, day_cap = (p[c].cast("double") for c in ("session_budget_usd", "daily_budget_usd"))
    rows = _with(placed, carry, SESSION_DAY, carry="carry")
    rows = (_with(rows, days, DAY, started="spent") if days is not None else rows.withColumn("started", F.lit(0).cast(MONEY)))
    before = (F.col("carry") + F.col("upto") - F.col("cost")).cast("double")
    open_ = (session_cap == 0) | (before < session_cap)
    rows = rows.withColumn("_open", open_).withColumn("take", F.when(F.col("_open"), F.col("cost")).otherwise(0).cast(MONEY))
    rows = scan(rows, DAY, EVENT_ORDER, running_sum={"day_upto": F.col("take")})
    day_before = (F.col("started") + F.col("day_upto") - F.col("take")).cast("double")
    return rows.withColumn("ok", F.col("_open") & ((day_cap == 0) | (day_before < day_cap))).drop("_open")


def _got(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SESSION_DAY).agg(F.sum(F.when(F.col("ok"), F.col("cost")).otherwise(0)).cast(MONEY).alias("got"))


def stopped_caps(
    events: DataFrame, policy: Mapping[str, object] | None = None, *,
    sessions: DataFrame | None = None, days: DataFrame | None = None,
) -> DataFrame:
    """Each event (tenant_id, session_id, event_id, ts, cost_usd) with ``verdict``, ``cap``, ``session_spent`` and
    ``day_spent``: 'ok', 'alert' once a cap is reached, or under action 'stop' 'refused' for calls after that.

    A session keeps its spend across days; days roll at UTC midnight. ``sessions`` (tenant_id, session_id, spent) and
    ``days`` (tenant_id, day, spent) say what was spent before. A missing cost is 0; costs are not negative."""
    p, stops = policy_columns(policy), {**POLICY_DEFAULTS, **(policy or {})}["action"] == "stop"
    rows = events.select(*SESSION, "event_id", F.col("ts").cast("double").alias("ts"), utc_day(F.col("ts")).alias("day"),
                         F.coalesce(F.col("cost_usd").cast(MONEY), F.lit(0).cast(MONEY)).alias("cost"))
    placed = held(scan(rows, SESSION_DAY, EVENT_ORDER, running_sum={"upto": F.col("cost")}))
    got = placed.groupBy(*SESSION_DAY).agg(F.sum("cost").cast(MONEY).alias("got"))
    if not stops:
        p = {**p, "session_budget_usd": F.lit(0.0), "daily_budget_usd": F.lit(0.0)}
        carry = _carried(got, sessions)
    else:
        got = held(got)
        carry, some, todo = held(_carried(got, sessions)), placed, None
        while todo is None or not todo.isEmpty():
            new = _got(_let_through(some, carry, days, p))
            if todo is not None:
                new = new.unionByName(got.join(_named(todo, DAY, "_k_"), _same(DAY, "_k_"), "left_anti"))
            got = held(new)
            after = held(_carried(got, sessions))
            todo = held(after.join(_named(carry, SESSION_DAY, "_k_", _was="carry"), _same(SESSION_DAY, "_k_"))
                        .where("carry != _was").select(*DAY).distinct())
            carry, some = after, placed.join(_named(todo, DAY, "_k_"), _same(DAY, "_k_"), "left_semi")
    told = _let_through(placed, carry, days, p)
    told = _with(told, got, SESSION_DAY, _got="got")
    told = _with(told, got.groupBy(*DAY).agg(F.sum("got").cast(MONEY).alias("all")), DAY, _all="all")
    ok, cost = F.col("ok"), F.col("cost")
    session = F.col("carry") + F.when(ok, F.col("upto")).otherwise(F.col("_got"))
    day = F.col("started") + F.when(ok, F.col("day_upto")).otherwise(F.least(F.col("day_upto") - F.col("take"), "_all"))
    told = told.withColumns({"session_spent": session.cast(MONEY), "day_spent": day.cast(MONEY)})
    reached = cap_hit(policy_columns(policy), F.col("session_spent").cast("double"), F.col("day_spent").cast("double"))
    return told.select(
        *SESSION, "event_id", "ts", "day",
        F.when(~ok, "refused").when(reached != "", "alert").otherwise("ok").alias("verdict"),
        reached.alias("cap"), "session_spent", "day_spent")
