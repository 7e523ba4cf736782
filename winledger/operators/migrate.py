"""Replaying golden cases on another model and reading the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.stats import newcombe
from winledger.operators.tasks import at
from winledger.plans.ordered import Ordered, scan
from winledger.plans.skew import salted
from winledger.schema import MONEY_SUM

MIN_EFFECT_POINTS = 5.0
MAX_ITERATIONS = 8
MIN_IMPROVEMENT_POINTS = 1.0


def replay_cases(golden: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """Golden cases with the fingerprints of their task's last attempt; others are dropped."""
    last = task_attempts.groupBy("tenant_id", F.col("task_id").alias("case_id")).agg(
        F.max_by(
            F.struct(
                F.col("input_shape.input_fingerprint").alias("input_fingerprint"),
                F.col("input_shape.system_prompt_fingerprint").alias("cache_key"),
            ),
            at(),
        ).alias("_l")
    )
    return golden.select(
        "tenant_id", "case_id", "cluster_id", "input_ref", "expected_ref", "verifier_spec"
    ).join(last, ["tenant_id", "case_id"]).select("*", "_l.*").drop("_l")


def stratified_sample(
    tasks: DataFrame, shares: DataFrame, *, fraction: float = 0.01, seed: int = 42
) -> DataFrame:
    """A sample of live tasks with a quota per cluster by cost share, at least one each.

    Members are those with the smallest seeded hash, so the sample is repeatable. Only tasks below a bound that a
    histogram of the hashes gives are ranked (``below_bound``)."""
    sizes = tasks.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_size"))
    everyone = Window.partitionBy()
    # One row per cluster.
    quotas = (
        sizes.withColumn("_target", F.greatest(
            F.lit(1.0), F.rint(F.lit(float(fraction)) * F.sum("_size").over(everyone))))
        .filter(F.col("cluster_id").isNotNull())
        .join(shares.select("cluster_id", F.col("share_of_cost").alias("_share")), "cluster_id",
              "left")
        .withColumn("_share", F.coalesce("_share", F.lit(0.0)))
        .withColumn("_all", F.sum("_share").over(everyone))
        .withColumn("_w", F.col("_share") / F.when(F.col("_all") == 0, 1.0).otherwise(F.col("_all")))
        .select("cluster_id", F.least(
            F.col("_size"), F.greatest(F.lit(1.0), F.rint(F.col("_target") * F.col("_w")))
        ).cast("long").alias("_quota"))
    )
    ranked = scan(
        below_bound(tasks, quotas, seed=seed), ["cluster_id"], ["_key", "tenant_id", "task_id"],
        running_sum={"_rank": F.lit(1)},
    )
    return ranked.filter(F.col("_rank") <= F.col("_quota")).drop("_key", "_rank", "_quota")


STEPS = 32
"""Steps of the hash histogram for each doubling of the hash: the bound lies a few hundredths above the quota."""


def below_bound(tasks: DataFrame, quotas: DataFrame, *, seed: int) -> DataFrame:
    """Tasks with ``_key``, their seeded hash, and ``_quota``, that are among the ``_quota`` smallest of their cluster or
    little above.

    Tasks are counted by cluster and by the logarithm of their hash, a few hundred counts for each cluster; the first
    step whose running count reaches the quota is the cluster's bound."""
    key = F.md5(F.concat_ws(":", F.col("tenant_id"), F.col("task_id"), F.lit(str(seed))))
    step = F.floor(F.log2(F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") + 1) * STEPS).cast("int")
    hashed = tasks.filter(F.col("cluster_id").isNotNull()).withColumn("_key", key).withColumn("_step", step)
    counts = hashed.groupBy("cluster_id", "_step").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("cluster_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("_upto", F.sum("_n").over(upto)).join(quotas, "cluster_id").filter(F.col("_upto") >= F.col("_quota"))
    # One row per cluster.
    bounds = reached.groupBy(F.col("cluster_id").alias("_of")).agg(F.min("_step").alias("_bound"), F.first("_quota").alias("_quota"))
    return hashed.join(F.broadcast(bounds), (F.col("cluster_id") == F.col("_of")) & (F.col("_step") <= F.col("_bound"))).drop(
        "_of", "_bound", "_step")


def dedup_cases(cases: DataFrame) -> DataFrame:
    """Cases with ``first_case_id``, the first case of the same input by (cache key, case id), and
    ``is_duplicate``. The first is an aggregate, so many copies of one input are combined early, and a
    fingerprint with very many cases is spread in the join back."""
    firsts = cases.groupBy("tenant_id", "input_fingerprint").agg(
        F.min(F.struct("cache_key", "case_id"))["case_id"].alias("first_case_id"), F.count(F.lit(1)).alias("_n"))
    return salted(cases, firsts, ["tenant_id", "input_fingerprint"], ["case_id"]).withColumn(
        "is_duplicate", F.col("case_id") != F.col("first_case_id")
    )


def reuse_verdicts(deduped: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes of all cases from the results of first cases (tenant_id, case_id, passed, cost_usd,
    latency_ms): a duplicate takes the verdict at no cost; a case never run has NULL ``passed``."""
    verdicts = results.select(
        "tenant_id", F.col("case_id").alias("first_case_id"), F.col("passed"), "cost_usd",
        "latency_ms", F.lit(True).alias("_ran"),
    )
    ran = F.coalesce(F.col("_ran"), F.lit(False))
    free = ~ran | F.col("is_duplicate")
    return deduped.join(verdicts, ["tenant_id", "first_case_id"], "left").select(
        "tenant_id", "case_id", "cluster_id", "first_case_id",
        F.col("passed"),
        F.when(free, F.lit(0)).otherwise(F.col("cost_usd")).cast("decimal(20,9)").alias("cost_usd"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        (ran & F.col("is_duplicate")).alias("deduped"),
    )


def budget_prefix(
    runs: DataFrame, *, cap, est, by=("model_id", "day"), order=("seq",), cost: str = "cost_usd"
) -> DataFrame:
    """Runs with ``ran``: whether the hard daily cap still allowed them.

    A run goes ahead while the estimate fits the remaining budget and some budget remains. What is
    left never grows, so this is exactly a test on the sum of earlier costs."""
    money = "decimal(28,9)"
    summed = scan(
        runs, list(by), list(order), running_sum={"_upto": F.col(cost), "_n": F.lit(1)}
    )
    prior = F.col("_upto") - F.col(cost)
    left = F.greatest(F.lit(0).cast(money), F.lit(str(cap)).cast(money) - prior)
    fits = F.lit(str(est)).cast(money) <= left
    return summed.withColumn("ran", fits & ((left > 0) | (F.col("_n") == 1))).drop("_upto", "_n")


def budget_summary(prefixed: DataFrame, *, by=("model_id", "day"), cost: str = "cost_usd"):
    """Per budget: runs, spend, skipped runs and whether the budget stopped it."""
    skipped = F.count_if(~F.col("ran"))
    return prefixed.groupBy(*by).agg(
        F.count_if("ran").alias("n_run"),
        skipped.alias("n_skipped_budget"),
        F.coalesce(F.sum(F.when(F.col("ran"), F.col(cost))), F.lit(0)).alias("spent_usd"),
        (skipped > 0).alias("budget_stopped"),
    )


def optimisation_result(
    iterations: DataFrame, *, cap, est, max_iterations: int = MAX_ITERATIONS,
    min_points: float = MIN_IMPROVEMENT_POINTS,
) -> tuple[DataFrame, DataFrame]:
    """(executed iterations, result per cluster) from a log (cluster_id, index from 0, pass_rate,
    cost_usd, base_pass_rate).

    The loop stops after two small improvements in a row, at ``max_iterations``, or before a step
    whose estimate does not fit the budget. ``over_cap`` marks a step that spent more than was left.
    """
    money = "decimal(28,9)"
    o = Ordered(iterations, ["cluster_id"], ["index"])
    o.add(running_max={"_upto": F.col("pass_rate")}, running_sum={"_spent": F.col("cost_usd")})
    o.add(lag={"_prev_best": F.col("_upto")})
    best = F.greatest(F.col("base_pass_rate"), F.col("_prev_best"))
    gain = (F.col("pass_rate") - best) * 100
    o.map(lambda d: d.withColumn("_gain", gain).withColumn("accepted", F.col("pass_rate") > best))
    o.add(lag={"_prev_gain": F.col("_gain")})
    small = (F.col("_gain") < min_points) & (F.col("_prev_gain") < min_points)
    o.map(lambda d: d.withColumn("_halt", F.coalesce(small, F.lit(False)).cast("int")))
    o.add(running_sum={"_halts": F.col("_halt")})
    prior = F.col("_spent") - F.col("cost_usd")
    blocked = prior + F.lit(str(est)).cast(money) > F.lit(str(cap)).cast(money)
    rows = o.result().withColumn("_blocked", blocked).withColumn(
        "over_cap", F.col("_spent") > F.lit(str(cap)).cast(money)
    )
    ran = (
        (F.col("index") < max_iterations)
        & (F.col("_halts") - F.col("_halt") == 0)
        & ~F.col("_blocked")
    )
    executed = rows.filter(ran)
    log = executed.select(
        "cluster_id", "index", "pass_rate", "cost_usd",
        F.bround("_gain", 2).alias("improvement_points"), "accepted", "over_cap",
    )
    base = rows.groupBy("cluster_id").agg(
        F.max("base_pass_rate").alias("base_pass_rate"),
        F.count_if(ran).alias("n_iterations"),
        F.max(F.when(ran, F.col("pass_rate"))).alias("_top"),
        F.coalesce(F.sum(F.when(ran, F.col("cost_usd"))), F.lit(0)).cast(money)
        .alias("total_cost_usd"),
        F.coalesce(F.max(F.when(ran, F.col("_halt"))), F.lit(0)).alias("_plateau"),
        F.coalesce(F.max(F.when(ran, F.col("over_cap"))), F.lit(False)).alias("over_cap"),
    )
    spent = F.col("total_cost_usd") + F.lit(str(est)).cast(money) > F.lit(str(cap)).cast(money)
    reason = (
        F.when(F.col("_plateau") == 1, "plateau")
        .when(F.col("n_iterations") >= max_iterations, "max_iterations")
        .when(spent, "budget").otherwise("open")
    )
    result = base.select(
        "cluster_id", "base_pass_rate",
        F.greatest("base_pass_rate", "_top").alias("best_pass_rate"),
        "n_iterations", "total_cost_usd", reason.alias("stop_reason"), "over_cap",
    )
    return log, result


def replay_cost(outcomes: DataFrame) -> DataFrame:
    """Per cluster: cases with a verdict, passes, cost per pass, mean latency of real runs."""
    wins = F.nullif(F.count_if("passed"), F.lit(0))
    real = F.col("passed").isNotNull() & ~F.col("deduped")
    return outcomes.groupBy("cluster_id").agg(
        F.count("passed").alias("n_to"),
        F.count_if("passed").alias("s_to"),
        (F.sum("cost_usd").cast(MONEY_SUM) / wins).alias("to_cpat"),
        F.avg(F.when(real, F.col("latency_ms"))).alias("mean_latency_ms"),
    )


def join_gap_inputs(clusters: DataFrame, baselines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Clusters with their baseline metrics and replay figures; ``has_data`` is false for clusters
    the replay or the baseline never reached."""
    base = baselines.select(
        "cluster_id",
        F.col("success_rate.n").alias("n_from"),
        F.col("success_rate.value").alias("_rate"),
        F.col("cpat_usd.value").alias("from_cpat"),
        F.col("ttat_seconds.value").alias("from_ttat"),
    )
    joined = clusters.join(base, "cluster_id", "left").join(
        replay_cost(outcomes), "cluster_id", "left"
    )
    return joined.withColumn("s_from", F.rint(F.col("_rate") * F.col("n_from")).cast("long")).withColumn(
        "has_data", F.col("_rate").isNotNull() & (F.coalesce("n_to", F.lit(0)) > 0)
    ).drop("_rate")


def engineer_days(edge_cases: Column, share: Column) -> Column:
    """A labelled heuristic for the work a blocked cluster needs, between 1 and 15 days."""
    days = 1.5 + 0.5 * edge_cases + 8.0 * share
    return F.bround(F.least(F.lit(15.0), F.greatest(F.lit(1.0), days)), 1)


def gap_report(
    clusters: DataFrame, baselines: DataFrame, outcomes: DataFrame,
    edge_counts: DataFrame | None = None, *, min_effect: float = MIN_EFFECT_POINTS,
) -> tuple[DataFrame, DataFrame]:
    """(one row per cluster with data, totals). BLOCK needs a real and large drop in pass rate."""
    rows = join_gap_inputs(clusters, baselines, outcomes)
    if edge_counts is not None:
        rows = rows.join(edge_counts.select("cluster_id", F.col("n").alias("_edge")), "cluster_id",
                         "left")
    else:
        rows = rows.withColumn("_edge", F.lit(0))
    ci = newcombe(F.col("s_to"), F.col("n_to"), F.col("s_from"), F.col("n_from"))
    from_pass = F.col("s_from") / F.nullif(F.col("n_from"), F.lit(0))
    to_pass = F.col("s_to") / F.nullif(F.col("n_to"), F.lit(0))
    rows = rows.withColumn("_ci", ci).withColumn("_d", (to_pass - from_pass) * 100)
    block = F.col("has_data") & (F.col("_ci.high") < 0) & (F.abs("_d") > min_effect)
    from_cpat = F.nullif(F.col("from_cpat").cast("double"), F.lit(0.0))
    from_ttat = F.nullif(F.col("from_ttat"), F.lit(0.0))
    days = engineer_days(F.coalesce("_edge", F.lit(0)), F.col("share_of_cost"))
    judged = rows.withColumn("_block", F.coalesce(block, F.lit(False)))
    gaps = judged.filter("has_data").select(
        "cluster_id", "share_of_cost",
        from_pass.alias("from_pass"), to_pass.alias("to_pass"),
        F.bround("_d", 1).alias("delta_points"),
        F.bround(F.col("_ci.low") * 100, 1).alias("ci_low_points"),
        F.bround(F.col("_ci.high") * 100, 1).alias("ci_high_points"),
        ((F.col("to_cpat").cast("double") - F.col("from_cpat").cast("double")) / from_cpat)
        .alias("delta_cost_pct"),
        ((F.col("mean_latency_ms") / 1000 - F.col("from_ttat")) / from_ttat)
        .alias("delta_latency_pct"),
        "n_from", "n_to",
        F.when(F.col("_block"), "BLOCK").otherwise("PASS").alias("verdict"),
        F.when(F.col("_block"), days).alias("engineer_days"),
    )
    totals = judged.agg(
        F.count_if(F.col("has_data") & ~F.col("_block")).alias("n_pass"),
        F.count_if("_block").alias("n_block"),
        F.count_if(~F.col("has_data")).alias("n_no_data"),
        F.bround(F.coalesce(F.sum(F.when(F.col("_block"), days)), F.lit(0.0)), 1)
        .alias("total_engineer_days"),
    )
    return gaps, totals
