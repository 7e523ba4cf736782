"""From attempts to tasks: chaining, assembly, links between neighbouring attempts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.plans.ordered import Ordered, scan
from winledger.schema import STATUS, TEMPLATE, grade_rank

GAP_SECONDS = 120
MIN_OVERLAP = 0.8

TASK = ["task_id", "tenant_id"]
"""The id first: rows are sorted by the first bytes of the first key, and a tenant has many tasks."""
SESSION = ["tenant_id", "session_id"]
IN_TIME = ["ts_start", "trace_id"]
"""Attempts are ordered by start, then by id."""


def at(prefix: str = "") -> Column:
    """The position of an attempt in its task, session or template."""
    return F.struct(F.col(f"{prefix}ts_start"), F.col(f"{prefix}trace_id"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two shingle sets; 1.0 when either is missing or both are empty."""
    union = F.size(F.array_union(a, b))
    share = F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))
    return F.when(a.isNull() | b.isNull(), 1.0).otherwise(F.coalesce(share, F.lit(1.0)))


def chain_attempts(
    attempts: DataFrame, *, gap_s: float = GAP_SECONDS, min_overlap: float = MIN_OVERLAP
) -> DataFrame:
    """Add ``task_key``: the id of the first attempt of the chain a row belongs to.

    A row joins its predecessor in the session when the template is the same, it starts less than
    ``gap_s`` after the predecessor ended, and the inputs overlap by more than ``min_overlap``.
    Rows without a session are their own chain and skip the window.
    """
    alone = attempts.filter(F.col("session_id").isNull()).withColumn("task_key", F.col("trace_id"))
    previous = F.struct(
        F.col("ts_end").alias("ts_end"),
        F.col(TEMPLATE).alias("template"),
        F.col("input_shingles").alias("shingles"),
    )
    rows = Ordered(attempts.filter(F.col("session_id").isNotNull()), SESSION, IN_TIME)
    rows.add(lag={"_prev": previous})
    gap = F.unix_micros("ts_start") - F.unix_micros(F.col("_prev.ts_end"))
    joins = (
        F.col("_prev").isNotNull()
        & F.col("_prev.template").eqNullSafe(F.col(TEMPLATE))
        & (gap < F.lit(int(gap_s * 1_000_000)))
        & (jaccard(F.col("_prev.shingles"), F.col("input_shingles")) > min_overlap)
    )
    rows.add(carry={"task_key": F.when(~joins, F.col("trace_id"))})
    chained = rows.result().drop("_prev")
    return chained.unionByName(alone)


def assemble_tasks(
    attempts: DataFrame, *, gap_s: float = GAP_SECONDS, min_overlap: float = MIN_OVERLAP
) -> tuple[DataFrame, DataFrame]:
    """(tasks, task_attempts). An explicit task id wins, per tenant; else attempts are chained.

    ``task_attempts`` is the input with ``task_id`` set. ``tasks`` is aggregated in two steps
    (task and model, then task), so a task with very many attempts is combined before the shuffle.
    """
    named = attempts.filter(F.col("explicit_task_id").isNotNull()).withColumn(
        "task_key", F.col("explicit_task_id")
    )
    chained = chain_attempts(
        attempts.filter(F.col("explicit_task_id").isNull()), gap_s=gap_s, min_overlap=min_overlap
    )
    rows = named.unionByName(chained).withColumn("task_id", F.col("task_key")).drop("task_key")
    return tasks_from(rows), rows


def tasks_from(task_attempts: DataFrame) -> DataFrame:
    """One row per task from attempts that already carry their ``task_id``.

    The models of a task are listed by a window over one row for each of them: its sort is the only one of the
    second step."""
    status = F.col(STATUS)
    failed = status == "fail"
    per_model = task_attempts.groupBy(*TASK, "model_id").agg(
        F.min(F.struct("ts_start", "trace_id", status.alias("status"))).alias("first_at"),
        F.max(F.col("ts_end")).alias("last_end"),
        F.count(F.lit(1)).alias("attempts"),
        F.max(status == "pass").alias("succeeded"),
        F.sum("cost_usd").alias("cost"),
        F.sum("latency.total_ms").alias("wall"),
        F.sum("tokens.input").alias("tok_in"),
        F.sum("tokens.output").alias("tok_out"),
        F.sum("tokens.reasoning").alias("tok_think"),
        F.min(F.when(status != "unknown", grade_rank(F.col("verification.evidence_grade"))))
        .alias("grade"),
        F.count_if(failed).alias("failed_attempts"),
        F.sum(F.when(failed, F.col("cost_usd"))).alias("failed_cost"),
    )
    # At most one entry per model of the task, so this list stays short.
    by_start = Window.partitionBy(*TASK).orderBy("first_at.ts_start", "first_at.trace_id", "model_id")
    listed = F.collect_list(F.struct("model_id")).over(
        by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    grades = F.array(F.lit("measured"), F.lit("derived"), F.lit("declared"))
    return (
        per_model.withColumn("_models", F.transform(listed, lambda m: m["model_id"]))
        .groupBy(*TASK)
        .agg(
            F.sum("attempts").alias("attempts"),
            F.max("succeeded").alias("succeeded"),
            F.sum("cost").cast("decimal(38,9)").alias("total_cost_usd"),
            F.sum("wall").alias("total_wall_ms"),
            F.struct(
                F.sum("tok_in").alias("input"),
                F.sum("tok_out").alias("output"),
                F.sum("tok_think").alias("reasoning"),
            ).alias("total_tokens"),
            F.first("_models").alias("models_used"),
            F.min("grade").alias("_grade"),
            F.sum("failed_attempts").alias("failed_attempts"),
            F.coalesce(F.sum("failed_cost"), F.lit(0)).cast("decimal(38,9)")
            .alias("failed_cost_usd"),
            F.min("first_at").alias("_first"),
            F.max("last_end").alias("ts_end"),
        )
        .withColumn("verification_grade", F.coalesce(F.get(grades, "_grade"), F.lit("unknown")))
        .withColumn("ts_start", F.col("_first.ts_start"))
        .withColumn("first_trace_id", F.col("_first.trace_id"))
        .withColumn("finishing_model", F.element_at("models_used", -1))
        .select(
            "tenant_id", "task_id", "attempts", "succeeded",
            (F.col("_first.status") == "pass").alias("first_attempt_success"), "total_cost_usd", "total_wall_ms",
            "total_tokens", "models_used", "failed_attempts", "failed_cost_usd", "ts_end", "verification_grade",
            "ts_start", "first_trace_id", "finishing_model",
        )
    )


def link_attempts(attempts: DataFrame) -> DataFrame:
    """Each attempt with the previous and next attempt of its session (id, gap in seconds) and
    whether a retry followed within ten minutes of its end. Rows without a session have none."""
    here = F.struct(
        F.col("trace_id").alias("trace_id"),
        F.unix_micros("ts_start").alias("start"),
        F.unix_micros("ts_end").alias("end"),
        F.col(TEMPLATE).alias("template"),
    )
    alone = attempts.filter(F.col("session_id").isNull())
    rows = attempts.filter(F.col("session_id").isNotNull())
    both = scan(rows, SESSION, IN_TIME, lag={"_prev": here}, lead={"_next": here})
    empty = F.lit(None).cast(both.schema["_prev"].dataType)
    both = both.unionByName(alone.withColumn("_prev", empty).withColumn("_next", empty))
    start, end = F.unix_micros("ts_start"), F.unix_micros("ts_end")
    retry = (
        F.col("_next.template").eqNullSafe(F.col(TEMPLATE))
        & (F.col("_next.start") - end <= 600_000_000)
    )
    return both.select(
        *attempts.columns,
        F.col("_prev.trace_id").alias("prev_trace_id"),
        ((start - F.col("_prev.end")) / 1e6).alias("prev_gap_s"),
        F.col("_next.trace_id").alias("next_trace_id"),
        ((F.col("_next.start") - end) / 1e6).alias("next_gap_s"),
        F.coalesce(retry, F.lit(False)).alias("retried_within_10m"),
    )


def _kept(task_attempts: DataFrame, columns: Mapping[str, Column] | None) -> Column:
    """What is carried of an attempt while one of a task's is chosen: ``columns``, by default all."""
    if columns is None:
        columns = {c: F.col(c) for c in task_attempts.columns if c not in ("tenant_id", "task_id")}
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def representative(task_attempts: DataFrame, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """The attempt that stands for a task: its last passing one, else its last. Only ``columns`` of it
    are shuffled."""
    rank = F.struct(
        F.coalesce((F.col(STATUS) == "pass").cast("int"), F.lit(0)),
        F.col("ts_start"), F.col("trace_id"),
    )
    return (
        task_attempts.groupBy(*TASK)
        .agg(F.max_by(_kept(task_attempts, columns), rank).alias("_rep"))
        .select("tenant_id", "task_id", "_rep.*")
    )


def last_passing(
    task_attempts: DataFrame, columns: Mapping[str, Column] | None = None, *, measured_only: bool = False
) -> DataFrame:
    """Each task's last passing attempt, of which only ``columns`` are shuffled; tasks without one are absent."""
    ok = F.col(STATUS) == "pass"
    if measured_only:
        ok = ok & (F.col("verification.evidence_grade") == "measured")
    return (
        task_attempts.filter(ok)
        .groupBy(*TASK)
        .agg(F.max_by(_kept(task_attempts, columns), at()).alias("_rep"))
        .select("tenant_id", "task_id", "_rep.*")
    )


def attach_clusters(tasks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tasks with ``cluster_id`` filled from (tenant_id, task_id, cluster_id)."""
    rest = [c for c in tasks.columns if c not in ("tenant_id", "task_id", "cluster_id")]
    return tasks.drop("cluster_id").join(
        assignments.select("tenant_id", "task_id", "cluster_id"), TASK, "left"
    ).select("tenant_id", "task_id", *rest, "cluster_id")
