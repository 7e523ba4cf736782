"""The report tables: leaderboard, receipt, routing advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winledger.operators import waste
from winledger.operators.metrics import axis_norms, core_metrics, norm_score
from winledger.plans.ordered import stored
from winledger.schema import MONEY_SUM

UNKNOWN_WARNING = 0.30
MAX_QUALITY_DROP_POINTS = 2.0


def _table(tasks: DataFrame, *scope: str) -> DataFrame:
    """What the reports read of the tasks, written once, as several parts of a report read it."""
    wanted = (*scope, *waste.READ, "finishing_model", "total_wall_ms", "total_tokens")
    return stored(tasks.select(*dict.fromkeys(wanted)))


def model_reports(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, *, period: Sequence[str] = ()
) -> DataFrame:
    """Metrics, waste, spend and token sums by finishing model (and period)."""
    return _model_reports(_table(tasks, *period), task_attempts, prices, period)


def _model_reports(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame, period: Sequence[str]
) -> DataFrame:
    by = [*period, "model_id"]
    named = tasks.withColumn("model_id", F.col("finishing_model"))
    metrics = core_metrics(named, by=by)
    sums = named.groupBy(*by).agg(
        F.sum("total_cost_usd").cast(MONEY_SUM).alias("spend_usd"),
        F.sum("total_tokens.input").alias("tokens_input"),
        F.sum("total_tokens.output").alias("tokens_output"),
        F.sum("total_tokens.reasoning").alias("tokens_reasoning"),
    )
    scoped = tasks.withColumn("_finisher", F.col("finishing_model"))
    wasted = waste.waste_of(
        scoped, task_attempts, prices, scope=[*period, "_finisher"]
    ).withColumnRenamed("_finisher", "model_id")
    return metrics.join(sums, by).join(wasted, by, "left")


def leaderboard(tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """One ranked row per model; scores are scaled across the whole workload."""
    rows = stored(model_reports(tasks, task_attempts, prices))  # one row per model
    scores = axis_norms(rows.withColumn("_all", F.lit(1)), cluster="_all").select(
        "model_id", norm_score().alias("score")
    )
    spend = F.nullif(F.col("spend_usd").cast("double"), F.lit(0.0))
    best = Window.orderBy(F.col("score").desc_nulls_last(), F.col("model_id"))
    return (
        rows.join(scores, "model_id", "left")
        .withColumn("waste_share", F.coalesce(F.col("total_usd").cast("double") / spend, F.lit(0.0)))
        .withColumn("rank", F.row_number().over(best))
        .withColumn(
            "score_class",
            F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "mid").otherwise("low"),
        )
    )


def report_totals(tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """The report's one-row summary with its unknown-rate warning."""
    tasks = _table(tasks)
    metrics = core_metrics(tasks)
    spend = tasks.agg(F.sum("total_cost_usd").cast(MONEY_SUM).alias("spend_usd"))
    wasted = waste.waste_of(tasks, task_attempts, prices)
    one = F.lit(1).alias("_one")
    joined = (
        metrics.select("*", one).join(spend.select("*", one), "_one")
        .join(wasted.select("*", one), "_one", "left").drop("_one")
    )
    total = F.nullif(F.col("spend_usd").cast("double"), F.lit(0.0))
    return joined.withColumn(
        "waste_share", F.col("total_usd").cast("double") / total
    ).withColumn(
        "unknown_high", F.coalesce(F.col("unknown_rate.value") > UNKNOWN_WARNING, F.lit(False))
    )


def receipt(
    tasks: DataFrame, task_attempts: DataFrame, prices: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(monthly totals, monthly rows per model), a task counted in the month it started."""
    dated = _table(tasks.withColumn("period", F.date_format("ts_start", "yyyy-MM")), "period")
    metrics = core_metrics(dated, by=["period"])
    spend = dated.groupBy("period").agg(
        F.sum("total_cost_usd").cast(MONEY_SUM).alias("spend_usd")
    )
    wasted = waste.waste_of(dated, task_attempts, prices, scope=["period"])
    total = F.nullif(F.col("spend_usd").cast("double"), F.lit(0.0))
    months = (
        metrics.join(spend, "period").join(wasted, "period", "left")
        .withColumn("delivered", F.col("cpat_usd.n_successes"))
        .withColumn("waste_share", F.col("total_usd").cast("double") / total)
    )
    return months, _model_reports(dated, task_attempts, prices, ["period"])


def recommend_routing(rows: DataFrame, *, period: Sequence[str] = ()) -> DataFrame:
    """Per period: whether the biggest spender's work should move to the best-value model.

    A recommendation with a derived estimate, never a routing decision. Ties go to the first name.
    """
    cost = F.col("cpat_usd.value").cast("double")
    ok = rows.filter(F.col("cpat_usd.value").isNotNull() & (cost != 0)
                     & F.col("success_rate.value").isNotNull())
    model = F.struct(
        "model_id",
        F.col("success_rate.value").alias("quality"),
        F.col("cpat_usd.value").alias("cpat"),
        F.col("cpat_usd.n_successes").alias("wins"),
    )
    picked = ok.groupBy(*period).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.min_by(model, F.struct(-F.col("spend_usd"), F.col("model_id"))).alias("spender"),
        F.min_by(model, F.struct(F.col("cpat_usd.value"), F.col("model_id"))).alias("best"),
    )
    if period:
        picked = rows.select(*period).distinct().join(picked, list(period), "left")
    delta = (F.col("best.quality") - F.col("spender.quality")) * 100
    enough = F.coalesce(F.col("n_models") >= 2, F.lit(False))
    same = F.col("best.model_id") == F.col("spender.model_id")
    drop = delta < -MAX_QUALITY_DROP_POINTS
    move = enough & ~same & ~drop
    saving = (F.col("spender.cpat") - F.col("best.cpat")) * F.col("spender.wins")
    return picked.select(
        *period,
        F.when(move, "move").otherwise("stay").alias("kind"),
        F.when(enough, F.col("spender.model_id")).alias("from_model"),
        F.when(enough & ~same, F.col("best.model_id")).alias("to_model"),
        F.when(move, saving).alias("est_monthly_savings_usd"),
        F.when(enough & ~same, F.bround(delta, 1)).alias("quality_delta_points"),
        F.when(~enough, "fewer than two comparable models")
        .when(same, "largest spend already on the best-value model")
        .when(drop, "cheaper model drops verified quality")
        .otherwise("derived estimate").alias("note"),
    )


def model_inventory(tasks: DataFrame) -> DataFrame:
    """Tasks and verified tasks per model that took part."""
    return (
        tasks.select(F.explode("models_used").alias("model_id"), "verification_grade")
        .groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.count_if(F.col("verification_grade") != "unknown").alias("n_verified"),
        )
    )


def majority_model(tasks: DataFrame) -> DataFrame:
    """The model that finished most tasks (ties: first name)."""
    counts = tasks.groupBy(F.col("finishing_model").alias("model_id")).agg(
        F.count(F.lit(1)).alias("n_tasks")
    )
    first = F.struct(-F.col("n_tasks"), F.col("model_id"))
    return counts.agg(
        F.min_by("model_id", first).alias("from_model"), F.max("n_tasks").alias("n_tasks")
    )
