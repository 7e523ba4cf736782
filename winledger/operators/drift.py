"""Canary windows and drift alerts with false-discovery control.

Everything after ``window_stats`` works on aggregated rows (models x clusters x windows), so the
few ordered single-partition steps see at most a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.stats import newcombe, two_proportion_p

MIN_EFFECT_POINTS = 5.0
CUSUM_THRESHOLD = 0.5
PAIR = ["model_id", "cluster_id"]


def window_bounds(width: str, ts: str = "ts_start") -> Column:
    """A tumbling window; weeks start on Monday (the epoch was a Thursday)."""
    if width in ("7 days", "1 week"):
        return F.window(ts, "7 days", startTime="4 days")
    return F.window(ts, width)


def window_stats(tasks: DataFrame, *, width: str = "1 day") -> DataFrame:
    """(model_id, cluster_id, ts, n, successes, rate) from verified tasks."""
    return (
        tasks.filter(F.col("verification_grade") != "unknown")
        .groupBy(
            F.element_at("models_used", -1).alias("model_id"), "cluster_id",
            window_bounds(width).alias("_w"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("successes"))
        .select(
            *PAIR, F.col("_w.start").alias("ts"), "n", "successes",
            (F.col("successes") / F.col("n")).alias("rate"),
        )
    )


def comparable_pairs(windows: DataFrame, baselines: DataFrame) -> DataFrame:
    """Non-empty windows of pairs that have a non-empty baseline, with the baseline's counts."""
    base = baselines.filter(F.col("n") > 0).select(
        *PAIR, F.col("successes").alias("base_successes"), F.col("n").alias("base_n")
    )
    return windows.filter(F.col("n") > 0).join(base, PAIR)


def cusum(
    df: DataFrame, rate: str, target: str, *, drift: float, h: float,
    by: Sequence[str], order: Sequence[str],
) -> DataFrame:
    """One-sided CUSUM for a fall below ``target``: adds ``cusum`` and ``cusum_crossed`` (so far).

    S_t = max(0, S_{t-1} + d_t) has the closed form C_t - min(0, min over j <= t of C_j), where C is
    the running sum of d."""
    step = F.col(target) - F.col(rate) - F.lit(drift / 2)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_c", F.sum(step).over(upto))
    level = F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(upto))
    return (
        summed.withColumn("cusum", level)
        .withColumn("cusum_crossed", F.max(F.col("cusum") > h).over(upto))
        .drop("_c")
    )


def benjamini_hochberg(df: DataFrame, p: str, *, q: float = 0.05) -> DataFrame:
    """Add ``q_value`` and ``rejected`` over all rows of an aggregated table."""
    everyone = Window.partitionBy()
    up = Window.orderBy(p)
    m = F.count(F.lit(1)).over(everyone)
    # Equal p-values share the largest of their ranks, which is all the step-up rule looks at.
    ranked = df.withColumn("_m", m).withColumn(
        "_rank", F.count(F.lit(1)).over(up.rangeBetween(Window.unboundedPreceding, 0))
    )
    passing = F.col(p) <= F.col("_rank") / F.col("_m") * q
    ranked = ranked.withColumn(
        "_cut", F.coalesce(F.max(F.when(passing, F.col("_rank"))).over(everyone), F.lit(0))
    )
    onward = up.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked.withColumn(
            "q_value",
            F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(onward)),
        )
        .withColumn("rejected", F.col("_rank") <= F.col("_cut"))
        .drop("_m", "_rank", "_cut")
    )


def judge_pairs(
    baselines: DataFrame, windows: DataFrame, *, min_effect: float = MIN_EFFECT_POINTS,
    q: float = 0.05, h: float = CUSUM_THRESHOLD,
) -> DataFrame:
    """One row per comparable pair with all four alert conditions and the p and q values."""
    rows = (
        comparable_pairs(windows, baselines)
        .withColumn("rate", F.col("successes") / F.col("n"))
        .withColumn("base_rate", F.col("base_successes") / F.col("base_n"))
    )
    ci = newcombe(F.col("successes"), F.col("n"), F.col("base_successes"), F.col("base_n"))
    points = (F.col("rate") - F.col("base_rate")) * 100
    rows = (
        rows.withColumn("ci", ci)
        .withColumn("delta", points)
        .withColumn("is_drop", (F.col("ci.high") < 0) & (F.abs(F.col("delta")) > min_effect))
    )
    rows = cusum(
        rows, "rate", "base_rate", drift=min_effect / 100, h=h, by=PAIR, order=["ts"]
    )
    in_time = Window.partitionBy(*PAIR).orderBy("ts")
    rows = rows.withColumn("prev_drop", F.lag("is_drop").over(in_time)).withColumn(
        "prev_ts", F.lag("ts").over(in_time)
    )
    whole = F.struct(*[c for c in rows.columns if c not in PAIR])
    last = rows.groupBy(*PAIR).agg(F.max_by(whole, F.col("ts")).alias("w")).select(*PAIR, "w.*")
    tested = last.withColumn(
        "p_value",
        two_proportion_p(
            F.col("successes"), F.col("n"), F.col("base_successes"), F.col("base_n")
        ),
    )
    return benjamini_hochberg(tested, "p_value", q=q).withColumn(
        "confirmed", F.coalesce(F.col("prev_drop"), F.lit(False))
    )


def detect_drift(
    baselines: DataFrame, windows: DataFrame, *, min_effect: float = MIN_EFFECT_POINTS,
    q: float = 0.05, h: float = CUSUM_THRESHOLD,
) -> DataFrame:
    """Alerts: the drop is real and large, confirmed by the previous window or CUSUM, and survives
    the false-discovery control over all pairs. Improvements never alert."""
    judged = judge_pairs(baselines, windows, min_effect=min_effect, q=q, h=h)
    fires = F.col("is_drop") & (F.col("confirmed") | F.col("cusum_crossed")) & F.col("rejected")
    return judged.filter(fires).select(
        *PAIR,
        F.col("base_rate").alias("baseline_rate"),
        F.col("rate").alias("current_rate"),
        F.bround("delta", 1).alias("delta_points"),
        F.bround(F.col("ci.low") * 100, 1).alias("ci_low_points"),
        F.bround(F.col("ci.high") * 100, 1).alias("ci_high_points"),
        "n",
        F.when(F.col("confirmed"), 2).otherwise(1).alias("confirmed_windows"),
        "cusum_crossed",
        F.bround("q_value", 3).alias("q_value"),
        F.when(F.col("confirmed"), F.col("prev_ts")).otherwise(F.col("ts")).alias("first_observed"),
    )
