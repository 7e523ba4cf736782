"""Waste, index, leaderboard, receipt."""

from pyspark.sql import functions as F

from winledger.operators import metrics, report, waste
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query
from winledger.queries.tasks import CORE_OUT_SQL, CORE_SQL, core_columns, lineitem_tasks


def _inputs(spark, sf_dir):
    t, rows = lineitem_tasks(spark, sf_dir)
    return t, rows, ad.prices_from_nation(spark, sf_dir)


def derived_sql(scope: str) -> str:
    """Row-level reasoning and context waste, one row per verified attempt, for a scope column."""
    return f"""
V as (select L.*, LT.finisher, strftime(LT.ts_start, '%Y-%m') as period, {scope} as scope
      from L join LT using (tenant_id, task_id) where LT.known),
B as (select scope, template, cast(floor(median(reasoning)) as bigint) as baseline
      from V where status = 'pass' group by all),
R as (
  select V.scope, V.trace_id, V.model_id, p_in, p_out,
    coalesce(reasoning > baseline, false) as is_over, reasoning - baseline as excess,
    tok_in - tok_cached as uncached,
    row_number() over (partition by V.scope, V.template order by V.ts_start, V.trace_id) as rn
  from V left join B on V.scope = B.scope and V.template = B.template
    left join P on V.model_id = P.model_id),
X as (
  select scope,
    coalesce(sum(case when is_over then excess * p_out / 1000000 end), 0) as reasoning_usd,
    count(*) filter (where is_over and p_out is not null) as reasoning_n,
    count(*) filter (where is_over and p_out is null) as reasoning_unpriced,
    coalesce(sum(case when rn > 1 and uncached > 0 then uncached * p_in / 1000000 end), 0)
      as context_usd,
    count(*) filter (where rn > 1 and uncached > 0 and p_in is not null) as context_n,
    count(*) filter (where rn > 1 and uncached > 0 and p_in is null) as context_unpriced,
    count(distinct case when p_in is null and (is_over or (rn > 1 and uncached > 0))
                   then trace_id end) as n_unpriced
  from R group by scope)"""


def measured_sql(scope: str) -> str:
    return f"""
W as (select {scope} as scope,
    cast(coalesce(sum(case when succeeded then failed_cost end), 0) as double) as retry_usd,
    cast(coalesce(sum(case when succeeded then failed_n end), 0) as bigint) as retry_n,
    cast(coalesce(sum(case when not succeeded then cost end), 0) as double) as dead_usd,
    cast(coalesce(sum(case when not succeeded then attempts end), 0) as bigint) as dead_n
  from LT where known group by all)"""


BASE = f"with {ad.LINEITEM_TASKS_SQL}, {ad.PRICES_SQL}"


@query("A6_waste_retry", f"""{BASE}, {measured_sql("'all'")}
select round(retry_usd, 4) as amount_usd, retry_n as n_traces, 'measured' as evidence_grade from W""")
def a6(spark, sf_dir):
    t, rows, p = _inputs(spark, sf_dir)
    return waste.waste_retry(t, rows, p).select(
        num("amount_usd", "amount_usd", 4), "n_traces", "evidence_grade")


@query("A7_waste_dead", f"""{BASE}, {measured_sql('tenant_id')}
select scope as tenant_id, round(dead_usd, 4) as amount_usd, dead_n as n_traces,
  'measured' as evidence_grade from W""")
def a7(spark, sf_dir):
    t, rows, p = _inputs(spark, sf_dir)
    return waste.waste_dead(t, rows, p, scope=["tenant_id"]).select(
        "tenant_id", num("amount_usd", "amount_usd", 4), "n_traces", "evidence_grade")


@query("A8_waste_reasoning", f"""{BASE}, {derived_sql("'all'")}
select round(cast(reasoning_usd as double), 8) as amount_usd, reasoning_n as n_traces,
  reasoning_unpriced as n_unpriced, 'derived' as evidence_grade from X""")
def a8(spark, sf_dir):
    return waste.waste_reasoning(*_inputs(spark, sf_dir)).select(
        num("amount_usd", "amount_usd", 8), "n_traces", "n_unpriced", "evidence_grade")


@query("A9_waste_context", f"""{BASE}, {derived_sql("'all'")}
select round(cast(context_usd as double), 8) as amount_usd, context_n as n_traces,
  context_unpriced as n_unpriced, 'derived' as evidence_grade from X""")
def a9(spark, sf_dir):
    return waste.waste_context(*_inputs(spark, sf_dir)).select(
        num("amount_usd", "amount_usd", 8), "n_traces", "n_unpriced", "evidence_grade")


@query("A10_waste_total", f"""{BASE}, {derived_sql('finisher')}, {measured_sql('finisher')}
select W.scope as model_id, round(retry_usd, 4) as retry_usd, retry_n, round(dead_usd, 4) as dead_usd,
  dead_n, round(cast(reasoning_usd as double), 8) as reasoning_usd, reasoning_n,
  round(cast(context_usd as double), 8) as context_usd, context_n,
  n_unpriced as n_unpriced_traces,
  round(retry_usd + dead_usd + cast(reasoning_usd as double) + cast(context_usd as double), 6)
    as total_usd
from W join X on W.scope = X.scope""")
def a10(spark, sf_dir):
    t, rows, p = _inputs(spark, sf_dir)
    scoped = t.withColumn("scope", F.col("finishing_model"))
    w = waste.waste_total(scoped, rows, p, scope=["scope"])
    return w.select(
        F.col("scope").alias("model_id"), num("retry_usd", "retry_usd", 4), "retry_n",
        num("dead_usd", "dead_usd", 4), "dead_n", num("reasoning_usd", "reasoning_usd", 8),
        "reasoning_n", num("context_usd", "context_usd", 8), "context_n", "n_unpriced_traces",
        num("total_usd", "total_usd", 6))


def norms_sql(source: str, cluster: str) -> str:
    """Axis norms over a table with cluster, model_id, success, cpat, ttat, wins."""
    def mm(x):
        lo, hi = f"min({x}) over w", f"max({x}) over w"
        return f"(case when {lo} = {hi} then 1e0 else ({x} - {lo}) / ({hi} - {lo}) end)"

    return f"""
N as (
  select {cluster} as cluster_id, model_id, wins, {mm('success')} as quality,
    {mm('ln(1e0 / ttat)')} as speed, {mm('ln(1e0 / cpat)')} as value
  from {source} where success is not null and cpat <> 0 and ttat <> 0
  window w as (partition by {cluster}))"""


CLUSTER_METRICS_SQL = """
CM as (select concat('k', cast(task_id as bigint) % 7) as cluster_id, finisher as model_id,
    count(*) filter (where known and succeeded) as wins,
    count(*) filter (where known and succeeded) / cast(count(*) filter (where known) as double)
      as success,
    cast(sum(case when known then cost end) as double)
      / nullif(count(*) filter (where known and succeeded), 0) as cpat,
    sum(case when known then wall end) / 1000e0
      / nullif(count(*) filter (where known and succeeded), 0) as ttat
  from LT group by all)"""


def _cluster_metrics(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    named = t.withColumn(
        "cluster_id", F.concat(F.lit("k"), (F.col("task_id").cast("long") % 7).cast("string"))
    ).withColumn("model_id", F.col("finishing_model"))
    shares = named.groupBy("cluster_id").agg(F.sum("total_cost_usd").alias("c"))
    total = shares.agg(F.sum("c").alias("all")).withColumn("one", F.lit(1))
    shares = shares.withColumn("one", F.lit(1)).join(total, "one").select(
        "cluster_id", (F.col("c").cast("double") / F.col("all").cast("double"))
        .alias("share_of_cost"))
    return metrics.core_metrics(named, by=["cluster_id", "model_id"]), shares


@query("A11_axis_norms", f"""{BASE}, {CLUSTER_METRICS_SQL}, {norms_sql('CM', 'cluster_id')}
select cluster_id, model_id, round(quality, 6) as quality, round(speed, 6) as speed,
  round(value, 6) as value, wins as n_successes from N""")
def a11(spark, sf_dir):
    m, _ = _cluster_metrics(spark, sf_dir)
    return metrics.axis_norms(m).select(
        "cluster_id", "model_id", num("quality", "quality"), num("speed", "speed"),
        num("value", "value"), "n_successes")


@query("A12_index_scores", f"""{BASE}, {CLUSTER_METRICS_SQL}, {norms_sql('CM', 'cluster_id')},
S as (select concat('k', cast(task_id as bigint) % 7) as cluster_id, cast(sum(cost) as double) as c
      from LT group by all),
T as (select sum(c) as a from S),
I as (select model_id, sum(100 * (0.6e0*quality + 0.2e0*speed + 0.2e0*value) * (c / a))
        / sum(c / a) as raw from N join S using (cluster_id), T group by model_id)
select model_id, round_even(raw, 1) as score,
  row_number() over (order by round_even(raw, 1) desc, model_id) as rank from I""")
def a12(spark, sf_dir):
    m, shares = _cluster_metrics(spark, sf_dir)
    return metrics.index_scores(metrics.axis_norms(m), shares).select(
        "model_id", "score", cnt("rank", "rank"))


MODEL_METRICS_SQL = f"""
MM as (select finisher as model_id, {CORE_SQL},
    cast(sum(cost) as double) as spend, cast(sum(tok_in) as bigint) as tokens_input,
    cast(sum(tok_out) as bigint) as tokens_output, cast(sum(tok_think) as bigint) as tokens_reasoning
  from LT group by finisher),
ME as (select *, wins / nullif(cast(n_verified as double), 0) as success,
    cost_sum / nullif(wins, 0) as cpat, wall_sum / nullif(wins, 0) as ttat, 1 as one from MM)"""


@query("A13_leaderboard", f"""{BASE}, {derived_sql('finisher')}, {measured_sql('finisher')},
{MODEL_METRICS_SQL}, {norms_sql('ME', 'one')},
Z as (select ME.*, retry_usd + dead_usd + cast(reasoning_usd as double)
        + cast(context_usd as double) as wasted,
      100 * (0.6e0*quality + 0.2e0*speed + 0.2e0*value) as score
  from ME left join N using (model_id) join W on W.scope = model_id join X on X.scope = model_id)
select model_id, round(score, 6) as score, row_number() over (order by score desc, model_id) as rank,
  case when score >= 80 then 'good' when score >= 60 then 'mid' else 'low' end as score_class,
  n_tasks, n_verified, wins, round(cpat, 8) as cpat, round(spend, 4) as spend_usd,
  round(wasted / spend, 6) as waste_share, tokens_input, tokens_output, tokens_reasoning
from Z""")
def a13(spark, sf_dir):
    return report.leaderboard(*_inputs(spark, sf_dir)).select(
        "model_id", num("score", "score"), cnt("rank", "rank"), "score_class", "n_tasks",
        "n_verified", F.col("cpat_usd.n_successes").alias("wins"), num("cpat_usd.value", "cpat", 8),
        num("spend_usd", "spend_usd", 4), num("waste_share", "waste_share"), "tokens_input",
        "tokens_output", "tokens_reasoning")


@query("A13_report_totals", f"""{BASE}, {derived_sql("'all'")}, {measured_sql("'all'")},
M as (select {CORE_SQL}, cast(sum(cost) as double) as spend from LT)
select {CORE_OUT_SQL}, round(spend, 4) as spend_usd,
  round((retry_usd + dead_usd + cast(reasoning_usd as double) + cast(context_usd as double)) / spend, 6)
    as waste_share, n_unpriced as n_unpriced_traces, n_unknown / cast(n_tasks as double) > 0.3
    as unknown_high
from M, W, X""")
def a13_totals(spark, sf_dir):
    return report.report_totals(*_inputs(spark, sf_dir)).select(
        *core_columns(), num("spend_usd", "spend_usd", 4), num("waste_share", "waste_share"),
        "n_unpriced_traces", "unknown_high")


@query("A38_receipt", f"""{BASE}, {derived_sql("strftime(LT.ts_start, '%Y-%m')")},
{measured_sql("strftime(ts_start, '%Y-%m')")},
M as (select strftime(ts_start, '%Y-%m') as period, {CORE_SQL}, cast(sum(cost) as double) as spend
      from LT group by all)
select period, round(spend, 4) as spend_usd, wins as delivered, n_verified, n_tasks,
  round(cost_sum / nullif(wins, 0), 8) as cpat,
  round((retry_usd + dead_usd + cast(reasoning_usd as double) + cast(context_usd as double)) / spend, 6)
    as waste_share
from M left join W on W.scope = period left join X on X.scope = period""")
def a38(spark, sf_dir):
    months, _ = report.receipt(*_inputs(spark, sf_dir))
    return months.select(
        "period", num("spend_usd", "spend_usd", 4), "delivered", "n_verified", "n_tasks",
        num("cpat_usd.value", "cpat", 8), num("waste_share", "waste_share"))


@query("A39_recommend_routing", f"""{BASE},
M as (select strftime(ts_start, '%Y-%m') as period, finisher as model_id, {CORE_SQL},
        sum(cost) as spend from LT group by all),
K as (select *, wins / nullif(cast(n_verified as double), 0) as q, cost_sum / nullif(wins, 0) as cpat
      from M),
G as (select period, count(*) as k,
    arg_min({{'m': model_id, 'q': q, 'c': cpat, 'w': wins}}, (-spend, model_id)) as s,
    arg_min({{'m': model_id, 'q': q, 'c': cpat, 'w': wins}}, (cpat, model_id)) as b
  from K where cpat <> 0 and q is not null group by period),
A as (select distinct period from M),
D as (select A.period, coalesce(k, 0) >= 2 as enough, s, b, s.m = b.m as same,
    (b.q - s.q) * 100 as delta from A left join G using (period))
select period, case when enough and not same and delta >= -2 then 'move' else 'stay' end as kind,
  case when enough then s.m end as from_model, case when enough and not same then b.m end as to_model,
  case when enough and not same and delta >= -2 then round((s.c - b.c) * s.w, 6) end as savings,
  case when enough and not same then round_even(delta, 1) end as quality_delta_points
from D""")
def a39(spark, sf_dir):
    _, rows = report.receipt(*_inputs(spark, sf_dir))
    return report.recommend_routing(rows, period=["period"]).select(
        "period", "kind", "from_model", "to_model", num("est_monthly_savings_usd", "savings", 6),
        "quality_delta_points")
