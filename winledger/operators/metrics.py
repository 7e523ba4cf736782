"""Success rate, cost and time per accepted task, with intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.stats import proportion
from winledger.schema import MONEY_SUM

WEIGHTS = (0.6, 0.2, 0.2)
"""Quality, speed, value."""


def _sums() -> list[Column]:
    known = F.col("verification_grade") != "unknown"
    return [
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(known).alias("n_verified"),
        F.count_if(known & F.col("succeeded")).alias("_wins"),
        F.sum(F.when(known, F.col("total_cost_usd"))).cast(MONEY_SUM).alias("_cost"),
        F.sum(F.when(known, F.col("total_wall_ms"))).alias("_wall"),
        F.sum(F.when(known, F.col("attempts"))).alias("_attempts"),
    ]


def _per_win(value: Column) -> Column:
    return F.struct(
        value.alias("value"),
        F.col("_wins").alias("n_successes"),
        F.col("n_verified").alias("n_tasks"),
    )


def _shape(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    wins = F.nullif(F.col("_wins"), F.lit(0))
    unknown = F.col("n_tasks") - F.col("n_verified")
    return sums.select(
        *by,
        "n_tasks",
        "n_verified",
        unknown.alias("n_unknown"),
        proportion(unknown, F.col("n_tasks")).alias("unknown_rate"),
        proportion(F.col("_wins"), F.col("n_verified")).alias("success_rate"),
        _per_win(F.col("_cost") / wins).alias("cpat_usd"),
        _per_win(F.col("_wall") / F.lit(1000.0) / wins).alias("ttat_seconds"),
        _per_win(F.col("_attempts").cast("double") / wins).alias("attempts_per_win"),
    )


def core_metrics(tasks: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per group; unknown tasks are counted but enter no rate, zero wins give NULL."""
    return _shape(tasks.groupBy(*by).agg(*_sums()), by)


def core_metrics_levels(tasks: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Several grouping levels in one pass; ``level`` is the grouping id of a row."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    sums = tasks.groupingSets(sets, *names).agg(*_sums(), F.grouping_id().alias("level"))
    return _shape(sums, [*names, "level"])


def core_metrics_by_model(tasks: DataFrame) -> DataFrame:
    """Metrics by the model that finished the task."""
    return core_metrics(
        tasks.withColumn("model_id", F.element_at("models_used", -1)), by=["model_id"]
    )


def _minmax(value: Column, by: Sequence[str]) -> Column:
    group = Window.partitionBy(*by)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(low == high, 1.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def axis_norms(metrics: DataFrame, *, cluster: str = "cluster_id") -> DataFrame:
    """Quality, speed and value of each model scaled to [0, 1] within its cluster.

    The input is already aggregated (models x clusters)."""
    quality = F.col("success_rate.value")
    cost = F.col("cpat_usd.value").cast("double")
    time = F.col("ttat_seconds.value")
    ok = metrics.filter(quality.isNotNull() & (cost != 0) & (time != 0))
    by = [cluster]
    return ok.select(
        cluster,
        "model_id",
        _minmax(quality, by).alias("quality"),
        _minmax(F.log(1.0 / time), by).alias("speed"),
        _minmax(F.log(1.0 / cost), by).alias("value"),
        F.col("cpat_usd.n_successes").alias("n_successes"),
    )


def norm_score(weights: Sequence[float] = WEIGHTS) -> Column:
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    q, s, v = weights
    return 100.0 * (
        F.lit(q) * F.col("quality") + F.lit(s) * F.col("speed") + F.lit(v) * F.col("value")
    )


def index_scores(
    norms: DataFrame, shares: DataFrame, *, weights: Sequence[float] = WEIGHTS
) -> DataFrame:
    """Per model: the cost-share weighted mean of its cluster scores, ranked.

    ``shares`` is (cluster_id, share_of_cost); a cluster without a share weighs nothing. The output
    has one row per model, so ranking it in one partition is fine."""
    scored = norms.withColumn("_score", norm_score(weights)).join(
        shares.select("cluster_id", F.col("share_of_cost").alias("_share")), "cluster_id", "left"
    )
    share = F.coalesce(F.col("_share"), F.lit(0.0))
    per_model = scored.groupBy("model_id").agg(
        (F.sum(F.col("_score") * share) / F.nullif(F.sum(share), F.lit(0.0))).alias("_raw"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct("cluster_id", F.bround("_score", 1).alias("score")))
            )
        ).alias("cluster_scores"),
    )
    scores = per_model.withColumn("score", F.bround("_raw", 1)).drop("_raw")
    return rank_rows(scores, [F.col("score").desc_nulls_last(), F.col("model_id")])


def rank_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of a small result table; ``medal`` names the first three."""
    rank = F.row_number().over(Window.orderBy(*order))
    medals = F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze"))
    return df.withColumn("rank", rank).withColumn("medal", F.get(medals, F.col("rank") - 1))
