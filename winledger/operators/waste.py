"""Where the money went without a result: retries, dead tasks, reasoning, uncached context.

Retry and dead waste are sums of recorded cost (measured). Reasoning and context waste compare with
a counterfactual (derived). Tasks graded unknown are left out.

The derived parts are computed on counts per (scope, template, model, reasoning tokens): a template
that holds most of the rows is combined before the shuffle and never meets a row-level window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winledger.operators.tasks import TASK
from winledger.plans.ordered import stored
from winledger.schema import MONEY_SUM, STATUS, TEMPLATE

PER_TOKEN = "decimal(18,12)"


def _verified(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("verification_grade") != "unknown")


def waste_retry(
    tasks: DataFrame, task_attempts: DataFrame = None, prices: DataFrame = None, *,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Cost of failed attempts in tasks that succeeded in the end."""
    won = F.col("succeeded")
    return _verified(tasks).groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(won, F.col("failed_cost_usd"))), F.lit(0)).cast(MONEY_SUM)
        .alias("amount_usd"),
        F.coalesce(F.sum(F.when(won, F.col("failed_attempts"))), F.lit(0)).alias("n_traces"),
    ).withColumn("evidence_grade", F.lit("measured"))


def waste_dead(
    tasks: DataFrame, task_attempts: DataFrame = None, prices: DataFrame = None, *,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Cost of verified tasks that never succeeded."""
    lost = ~F.col("succeeded")
    return _verified(tasks).groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(lost, F.col("total_cost_usd"))), F.lit(0)).cast(MONEY_SUM)
        .alias("amount_usd"),
        F.coalesce(F.sum(F.when(lost, F.col("attempts"))), F.lit(0)).alias("n_traces"),
    ).withColumn("evidence_grade", F.lit("measured"))


def _derived(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """One row per (scope, template, model, reasoning) with what each group wasted."""
    rows = task_attempts.select(
        "tenant_id", "task_id", "model_id", "ts_start", "trace_id",
        F.col(TEMPLATE).alias("template"),
        F.col("tokens.reasoning").alias("reasoning"),
        (F.col("tokens.input") - F.col("tokens.input_cached")).alias("uncached"),
        (F.col(STATUS) == "pass").alias("passed"),
    ).join(_verified(tasks).select("tenant_id", "task_id", *scope), TASK)
    spare = F.greatest(F.col("uncached"), F.lit(0))
    groups = rows.groupBy("reasoning", "template", "model_id", *scope).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("n_pass"),
        F.count_if(F.col("uncached") > 0).alias("n_spare"),
        F.sum(spare).alias("spare"),
        F.min(F.struct("ts_start", "trace_id", spare.alias("spare"))).alias("first"),
    )
    part = Window.partitionBy(*scope, "template")
    upto = part.orderBy("reasoning", "model_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        groups.withColumn("cum", F.sum("n_pass").over(upto))
        .withColumn("total", F.sum("n_pass").over(part))
        .withColumn("opening", F.min("first").over(part))
    )

    def at_position(position):
        hit = (F.col("n_pass") > 0) & (F.col("cum") >= position)
        return F.min(F.when(hit, F.col("reasoning"))).over(part)

    placed = placed.withColumn("low", at_position(F.expr("(total + 1) div 2"))).withColumn(
        "high", at_position(F.expr("total div 2 + 1"))
    )
    priced = placed.withColumn("baseline", F.expr("(low + high) div 2")).join(
        prices.select(
            "model_id",
            (F.col("input_per_mtok") * F.lit("0.000001").cast("decimal(7,6)")).cast(PER_TOKEN)
            .alias("p_in"),
            (F.col("output_per_mtok") * F.lit("0.000001").cast("decimal(7,6)")).cast(PER_TOKEN)
            .alias("p_out"),
        ),
        "model_id", "left",
    )
    opens = F.col("first").eqNullSafe(F.col("opening"))
    opening_spare = F.when(opens, F.col("first.spare")).otherwise(0)
    over = F.coalesce(F.col("reasoning") > F.col("baseline"), F.lit(False))
    return (
        priced.withColumn("over", over)
        .withColumn("excess", F.when(over, (F.col("reasoning") - F.col("baseline")) * F.col("n")))
        .withColumn("ctx_n", F.col("n_spare") - (opening_spare > 0).cast("long"))
        .withColumn("ctx_tokens", F.col("spare") - opening_spare)
    )


def _money(tokens, price):
    return F.coalesce(F.sum(tokens.cast("decimal(18,0)") * price), F.lit(0)).cast(MONEY_SUM)


def waste_reasoning(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, *, scope: Sequence[str] = ()
) -> DataFrame:
    """Reasoning tokens above the median of passing attempts of the template, at output price."""
    priced = F.col("p_out").isNotNull()
    return _derived(tasks, task_attempts, prices, scope).groupBy(*scope).agg(
        _money(F.col("excess"), F.col("p_out")).alias("amount_usd"),
        F.coalesce(F.sum(F.when(F.col("over") & priced, F.col("n"))), F.lit(0)).alias("n_traces"),
        F.coalesce(F.sum(F.when(F.col("over") & ~priced, F.col("n"))), F.lit(0))
        .alias("n_unpriced"),
    ).withColumn("evidence_grade", F.lit("derived"))


def waste_context(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, *, scope: Sequence[str] = ()
) -> DataFrame:
    """Uncached input of every attempt but the template's first, at input price."""
    priced = F.col("p_in").isNotNull()
    return _derived(tasks, task_attempts, prices, scope).groupBy(*scope).agg(
        _money(F.col("ctx_tokens"), F.col("p_in")).alias("amount_usd"),
        F.coalesce(F.sum(F.when(priced, F.col("ctx_n"))), F.lit(0)).alias("n_traces"),
        F.coalesce(F.sum(F.when(~priced, F.col("ctx_n"))), F.lit(0)).alias("n_unpriced"),
    ).withColumn("evidence_grade", F.lit("derived"))


def waste_total(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, *, scope: Sequence[str] = ()
) -> DataFrame:
    """All four parts, their total, and the distinct attempts that had no price.

    The parts may overlap. Baselines and first occurrences are those of the scope, so per-model
    figures need not add up to the overall ones. Verified tasks are written once, as both halves read them."""
    wanted = [*scope, *READ]
    return waste_of(stored(_verified(tasks).select(*dict.fromkeys(wanted))), task_attempts, prices, scope=scope)


READ = (
    "tenant_id", "task_id", "succeeded", "verification_grade", "failed_cost_usd", "failed_attempts", "total_cost_usd",
    "attempts",
)
"""What waste reads of a task."""


def waste_of(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, *, scope: Sequence[str] = ()
) -> DataFrame:
    """``waste_total`` of tasks that are a table already."""
    won, lost = F.col("succeeded"), ~F.col("succeeded")

    def money(when, col):
        return F.coalesce(F.sum(F.when(when, F.col(col))), F.lit(0)).cast(MONEY_SUM)

    def count(when, col):
        return F.coalesce(F.sum(F.when(when, F.col(col))), F.lit(0))

    measured = _verified(tasks).groupBy(*scope).agg(
        money(won, "failed_cost_usd").alias("retry_usd"),
        count(won, "failed_attempts").alias("retry_n"),
        money(lost, "total_cost_usd").alias("dead_usd"),
        count(lost, "attempts").alias("dead_n"),
    )
    priced, over = F.col("p_out").isNotNull(), F.col("over")
    derived = _derived(tasks, task_attempts, prices, scope).groupBy(*scope).agg(
        _money(F.col("excess"), F.col("p_out")).alias("reasoning_usd"),
        count(over & priced, "n").alias("reasoning_n"),
        _money(F.col("ctx_tokens"), F.col("p_in")).alias("context_usd"),
        count(priced, "ctx_n").alias("context_n"),
        F.coalesce(
            F.sum(F.when(~priced, F.when(over, F.col("n")).otherwise(F.col("ctx_n")))), F.lit(0)
        ).alias("n_unpriced_traces"),
    )
    if scope:
        both = measured.join(derived, list(scope), "left")
    else:
        both = measured.withColumn("_one", F.lit(1)).join(
            derived.withColumn("_one", F.lit(1)), "_one", "left"
        ).drop("_one")
    filled = both.fillna(0)
    total = F.col("retry_usd") + F.col("reasoning_usd") + F.col("context_usd") + F.col("dead_usd")
    return filled.withColumn("total_usd", total.cast(MONEY_SUM))
