"""Replay, gap report, budgets."""

from pyspark.sql import functions as F

from winledger.operators import cluster, metrics, migrate
from winledger.plans import adapters as ad
from winledger.queries import num, query
from winledger.queries.packs import CLUSTERED_SQL, clustered
from winledger.queries.tasks import NEWCOMBE_SQL, wilson_sql

NUMBER_OF = "cast(task_id as bigint)"


def _golden(spark, sf_dir):
    """Every succeeded task as a case."""
    t, rows = clustered(spark, sf_dir)
    golden = t.filter("succeeded").select(
        "tenant_id", F.col("task_id").alias("case_id"), "cluster_id",
        F.concat(F.lit("trace://"), "first_trace_id", F.lit("/input")).alias("input_ref"),
        F.concat(F.lit("trace://"), "first_trace_id", F.lit("/output")).alias("expected_ref"),
        F.lit("flag").alias("verifier_spec"))
    return golden, t, rows


CASES_SQL = CLUSTERED_SQL + """,
LL as (select tenant_id, task_id, arg_max({'f': input_fp, 'c': template}, (ts_start, trace_id)) as r
       from L group by all),
CA as (select LC.tenant_id, LC.task_id as case_id, cluster_id, r.f as input_fingerprint,
         r.c as cache_key from LC join LL using (tenant_id, task_id) where succeeded),
FI as (select tenant_id, input_fingerprint, arg_min(case_id, (cache_key, case_id)) as first_case_id
       from CA group by all),
DE as (select CA.*, first_case_id, case_id <> first_case_id as is_duplicate
       from CA join FI using (tenant_id, input_fingerprint))"""


@query("J1_replay_cases", f"""
with {CASES_SQL} select tenant_id, case_id, cluster_id, input_fingerprint, cache_key from CA""")
def j1(spark, sf_dir):
    golden, _, rows = _golden(spark, sf_dir)
    return migrate.replay_cases(golden, rows).select(
        "tenant_id", "case_id", "cluster_id", "input_fingerprint", "cache_key")


@query("W7_dedup_cases", f"""
with {CASES_SQL},
R as (select DE.*, cast(first_case_id as bigint) % 5 <> 0 as ran from DE)
select tenant_id, case_id, first_case_id,
  case when ran then cast(first_case_id as bigint) % 3 <> 0 end as passed,
  case when ran and not is_duplicate then 1.5e0 else 0e0 end as cost_usd,
  case when ran then cast(first_case_id as bigint) % 900 else 0 end as latency_ms,
  ran and is_duplicate as deduped from R""")
def w7(spark, sf_dir):
    golden, _, rows = _golden(spark, sf_dir)
    deduped = migrate.dedup_cases(migrate.replay_cases(golden, rows))
    n = F.col("case_id").cast("long")
    results = deduped.filter(~F.col("is_duplicate") & (n % 5 != 0)).select(
        "tenant_id", "case_id", (n % 3 != 0).alias("passed"),
        F.lit("1.5").cast("decimal(20,9)").alias("cost_usd"), (n % 900).alias("latency_ms"))
    return migrate.reuse_verdicts(deduped, results).select(
        "tenant_id", "case_id", "first_case_id", "passed", num("cost_usd", "cost_usd"),
        "latency_ms", "deduped")


def _shares(t):
    return t.groupBy("cluster_id").agg(
        (F.count_if(F.col("succeeded")) / F.lit(100.0)).alias("share_of_cost"))


@query("W6_stratified_sample", f"""
with {CLUSTERED_SQL},
S as (select cluster_id, count(*) as size, count(*) filter (where succeeded) / 100e0 as share
      from LC group by all),
Q as (select cluster_id, least(size, greatest(1, round_even(
        greatest(1, round_even(0.1e0 * (sum(size) over ()), 0)) * (share / sum(share) over ()), 0)))
        as quota from S),
R as (select *, row_number() over (partition by cluster_id
        order by md5(concat(tenant_id, ':', task_id, ':42')), tenant_id, task_id) as rk from LC)
select tenant_id, task_id, cluster_id from R join Q using (cluster_id) where rk <= quota""")
def w6(spark, sf_dir):
    t, _ = clustered(spark, sf_dir)
    return migrate.stratified_sample(t, _shares(t), fraction=0.1).select(
        "tenant_id", "task_id", "cluster_id")


ORDER_RUNS_SQL = """
RU as (select o_orderkey as seq, concat('m', o_custkey % 3) as model_id,
         strftime(o_orderdate, '%Y-%m') as day, cast(o_totalprice as decimal(20,2)) as cost
       from orders),
RS as (select *, sum(cost) over (partition by model_id, day order by seq rows unbounded preceding)
         - cost as prior,
         row_number() over (partition by model_id, day order by seq) as n from RU),
RR as (select *, 50000 <= greatest(0, 2000000 - prior) and (2000000 - prior > 0 or n = 1) as ran
       from RS)"""


def _order_runs(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("day"),
        F.col("o_totalprice").cast("decimal(20,2)").alias("cost_usd"))
    return migrate.budget_prefix(runs, cap=2000000, est=50000)


@query("W8_budget_prefix", f"with {ORDER_RUNS_SQL} select seq, ran from RR")
def w8(spark, sf_dir):
    return _order_runs(spark, sf_dir).select("seq", "ran")


@query("W8_budget_summary", f"""
with {ORDER_RUNS_SQL}
select model_id, day, count(*) filter (where ran) as n_run,
  count(*) filter (where not ran) as n_skipped_budget,
  cast(coalesce(sum(case when ran then cost end), 0) as double) as spent_usd,
  count(*) filter (where not ran) > 0 as budget_stopped from RR group by all""")
def w8_summary(spark, sf_dir):
    return migrate.budget_summary(_order_runs(spark, sf_dir)).withColumn(
        "spent_usd", F.col("spent_usd").cast("double"))


@query("W9_optimisation_result", """
with recursive I as (
  select cast(o_custkey as varchar) as cluster_id,
    row_number() over (partition by o_custkey order by o_orderkey) - 1 as i,
    0.4e0 + (o_orderkey % 37) / 100e0 as rate, cast(0.05 as decimal(9,2))
      + cast((o_orderkey % 11) as decimal(9,2)) / 100 as cost from orders),
R(cluster_id, i, best, spent, small, stop, n) as (
  select distinct cluster_id, cast(-1 as bigint), 0.5e0, cast(0 as decimal(18,4)), 0, '', 0 from I
  union all
  select R.cluster_id, R.i + 1, greatest(best, rate), cast(spent + round(cost, 2) as decimal(18,4)),
    case when (rate - best) * 100 < 1 then small + 1 else 0 end,
    case when (rate - best) * 100 < 1 and small + 1 >= 2 then 'plateau'
         when R.i + 2 >= 8 then 'max_iterations' else '' end, n + 1
  from R join I on I.cluster_id = R.cluster_id and I.i = R.i + 1
  where stop = '' and spent + 0.05 <= 0.6)
select cluster_id, n as n_iterations, round(best, 6) as best_pass_rate,
  cast(spent as double) as total_cost_usd, case when stop <> '' then stop
    when spent + 0.05 > 0.6 then 'budget' else 'open' end as stop_reason
from (select *, row_number() over (partition by cluster_id order by i desc) as b from R) where b = 1""")
def w9(spark, sf_dir):
    from pyspark.sql import Window

    o = ad.table(spark, sf_dir, "orders")
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    log = o.select(
        F.col("o_custkey").cast("string").alias("cluster_id"), index.alias("index"),
        (F.lit(0.4) + (F.col("o_orderkey") % 37) / F.lit(100.0)).alias("pass_rate"),
        (F.lit("0.05").cast("decimal(9,2)")
         + ((F.col("o_orderkey") % 11).cast("decimal(9,2)") / 100).cast("decimal(9,2)"))
        .cast("decimal(20,9)").alias("cost_usd"),
        F.lit(0.5).alias("base_pass_rate"))
    _, result = migrate.optimisation_result(log, cap="0.6", est="0.05")
    return result.select("cluster_id", F.col("n_iterations").cast("int").alias("n_iterations"),
                         num("best_pass_rate", "best_pass_rate"),
                         num("total_cost_usd", "total_cost_usd"), "stop_reason")


OUTCOMES_SQL = CLUSTERED_SQL + f""",
OU as (select cluster_id, {NUMBER_OF} % 4 <> 0 as passed, cast(cost as double) * 0.8e0 as cost,
         wall // 2 as latency, {NUMBER_OF} % 3 = 0 as deduped
       from LC where cluster_id <> 'k0'),
RC as (select cluster_id, count(*) as n_to, count(*) filter (where passed) as s_to,
    sum(cost) / nullif(count(*) filter (where passed), 0) as to_cpat,
    avg(case when not deduped then latency end) as lat from OU group by all)"""


def _outcomes(t):
    n = F.col("task_id").cast("long")
    return t.filter(F.col("cluster_id") != "k0").select(
        F.col("task_id").alias("case_id"), "cluster_id", (n % 4 != 0).alias("passed"),
        (F.col("total_cost_usd").cast("decimal(20,9)") * F.lit("0.8").cast("decimal(2,1)"))
        .alias("cost_usd"),
        F.expr("total_wall_ms div 2").alias("latency_ms"), (n % 3 == 0).alias("deduped"))


@query("A23_replay_cost", f"""
with {OUTCOMES_SQL}
select cluster_id, n_to, s_to, round(to_cpat, 5) as to_cpat, round(lat, 5) as mean_latency_ms from RC""")
def a23(spark, sf_dir):
    t, _ = clustered(spark, sf_dir)
    return migrate.replay_cost(_outcomes(t)).select(
        "cluster_id", "n_to", "s_to", num("to_cpat", "to_cpat", 5),
        num("mean_latency_ms", "mean_latency_ms", 5))


BASE_SQL = OUTCOMES_SQL + """,
BA as (select cluster_id, count(*) filter (where known) as n_from,
    count(*) filter (where known and succeeded) as s_from,
    cast(sum(case when known then cost end) as double)
      / nullif(count(*) filter (where known and succeeded), 0) as from_cpat,
    sum(case when known then wall end) / 1000e0
      / nullif(count(*) filter (where known and succeeded), 0) as from_ttat,
    cast(sum(cost) as double) as c from LC group by all),
CS as (select *, c / sum(c) over () as share from BA),
GI as (select CS.*, n_to, s_to, to_cpat, lat,
    coalesce(n_to, 0) > 0 and n_from > 0 and cluster_id <> 'k1' as has_data,
    s_from as s0, n_from as n0, s_to as s1, n_to as n1
  from CS left join RC using (cluster_id))"""


def _gap_inputs(spark, sf_dir):
    t, _ = clustered(spark, sf_dir)
    label = F.expr("cast(substring(cluster_id, 2) as int)")
    given = t.select("tenant_id", "task_id", label.alias("label"))
    clusters, _ = cluster.rank_clusters(given, t)
    clusters = clusters.select(
        F.concat(F.lit("k"), F.col("label").cast("string")).alias("cluster_id"), "share_of_cost")
    base = metrics.core_metrics(t, by=["cluster_id"]).filter("cluster_id <> 'k1'")
    edge = t.groupBy("cluster_id").agg(F.lit(4).alias("n"))
    return clusters, base, _outcomes(t), edge


@query("J8_join_gap_inputs", f"""
with {BASE_SQL}
select cluster_id, round(share, 6) as share_of_cost,
  case when cluster_id <> 'k1' then n_from end as n_from,
  case when cluster_id <> 'k1' then s_from end as s_from, n_to, s_to, has_data from GI""")
def j8(spark, sf_dir):
    c, b, o, _ = _gap_inputs(spark, sf_dir)
    return migrate.join_gap_inputs(c, b, o).select(
        "cluster_id", num("share_of_cost", "share_of_cost"), "n_from", "s_from", "n_to", "s_to",
        "has_data")


GAP_SQL = BASE_SQL + f""",
GD as (select *, s1 / cast(n1 as double) as p1, s0 / cast(n0 as double) as p0,
    s1 / cast(n1 as double) - s0 / cast(n0 as double) as d,
    {wilson_sql('s1', 'n1', 'low')} as l1, {wilson_sql('s1', 'n1', 'high')} as h1,
    {wilson_sql('s0', 'n0', 'low')} as l0, {wilson_sql('s0', 'n0', 'high')} as h0
  from GI where has_data),
GC as (select *, {NEWCOMBE_SQL.replace(', 6)', ', 12)')} from GD),
GB as (select *, ci_high < 0 and abs((p1 - p0) * 100) > 5 as is_block,
  round_even(least(15e0, greatest(1e0, 1.5e0 + 0.5e0 * 4 + 8 * share)), 1) as days from GC)"""


@query("A24_gap_report", f"""
with {GAP_SQL}
select cluster_id, round(p0, 6) as from_pass, round(p1, 6) as to_pass,
  round_even((p1 - p0) * 100, 1) as delta_points, round_even(ci_low * 100, 1) as ci_low_points,
  round_even(ci_high * 100, 1) as ci_high_points,
  round((to_cpat - from_cpat) / from_cpat, 6) as delta_cost_pct,
  round((lat / 1000 - from_ttat) / from_ttat, 6) as delta_latency_pct, n_from, n_to,
  case when is_block then 'BLOCK' else 'PASS' end as verdict,
  case when is_block then days end as engineer_days from GB""")
def a24(spark, sf_dir):
    gaps, _ = migrate.gap_report(*_gap_inputs(spark, sf_dir))
    return gaps.drop("share_of_cost").withColumns({
        c: F.round(c, 6) for c in ("from_pass", "to_pass", "delta_cost_pct", "delta_latency_pct")})


@query("A24_gap_totals", f"""
with {GAP_SQL}
select (select count(*) from GB where not is_block) as n_pass,
  (select count(*) from GB where is_block) as n_block,
  (select count(*) from GI where not has_data) as n_no_data,
  (select round_even(coalesce(sum(days), 0e0), 1) from GB where is_block) as total_engineer_days""")
def a24_totals(spark, sf_dir):
    _, totals = migrate.gap_report(*_gap_inputs(spark, sf_dir))
    return totals
