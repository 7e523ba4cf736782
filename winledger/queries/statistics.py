"""Canary windows, tests, control charts, drift."""

from pyspark.sql import functions as F

from winledger.functions import stats
from winledger.operators import drift, tasks
from winledger.plans import adapters as ad
from winledger.queries import num, query
from winledger.queries.tasks import NEWCOMBE_SQL, wilson_sql

SPLIT = "2024-01-11"


def _event_singles(spark, sf_dir):
    """Every event as a task of its own, clustered by user."""
    a = ad.attempts_from_events(spark, sf_dir).withColumn("explicit_task_id", F.col("trace_id"))
    t, _ = tasks.assemble_tasks(a)
    first = a.select("tenant_id", F.col("trace_id").alias("task_id"),
                     F.concat(F.lit("c"), (F.col("session_id").cast("long") % 3).cast("string"))
                     .alias("cluster_id"), F.col("verification.signal").alias("kind"))
    return t.join(first, ["tenant_id", "task_id"])


def _windows(spark, sf_dir, width="7 days"):
    """Weekly windows after the split, and baselines without clicks before it."""
    t = _event_singles(spark, sf_dir)
    w = drift.window_stats(t.filter(F.col("ts_start") >= SPLIT), width=width)
    base = drift.window_stats(
        t.filter((F.col("ts_start") < SPLIT) & (F.col("kind") != "click")), width="1 day"
    ).groupBy("model_id", "cluster_id").agg(
        F.sum("n").alias("n"), F.sum("successes").alias("successes"))
    return w, base


SINGLES_SQL = ad.EVENTS_SQL + """,
EV as (select *, concat('c', user_id % 3) as cluster_id from E where status <> 'unknown')"""

WEEKS_SQL = SINGLES_SQL + f""",
WN as (select model_id, cluster_id, time_bucket(interval '7 days', ts_start, timestamp '1970-01-05')
        as ts, count(*) as n, count(*) filter (where status = 'pass') as successes
       from EV where ts_start >= timestamp '{SPLIT}' group by all),
BL as (select model_id, cluster_id, count(*) as n0, count(*) filter (where status = 'pass') as s0
       from EV where ts_start < timestamp '{SPLIT}' and event_type <> 'click' group by all)"""


@query("A25_window_stats", f"""
with {SINGLES_SQL}
select model_id, cluster_id, cast(epoch_us(date_trunc('hour', ts_start)) as bigint) as ts_us,
  count(*) as n, count(*) filter (where status = 'pass') as successes,
  round(count(*) filter (where status = 'pass') / cast(count(*) as double), 6) as rate
from EV group by all""")
def a25(spark, sf_dir):
    return drift.window_stats(_event_singles(spark, sf_dir), width="1 hour").select(
        "model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"), "n", "successes",
        num("rate", "rate"))


@query("A25_window_stats_weekly", f"""
with {WEEKS_SQL}
select model_id, cluster_id, cast(epoch_us(ts) as bigint) as ts_us, n, successes from WN""")
def a25_weekly(spark, sf_dir):
    w, _ = _windows(spark, sf_dir)
    return w.select("model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"), "n", "successes")


@query("J13_comparable_pairs", f"""
with {WEEKS_SQL}
select model_id, cluster_id, cast(epoch_us(ts) as bigint) as ts_us, n, successes,
  s0 as base_successes, n0 as base_n
from WN join BL using (model_id, cluster_id) where model_id <> 'model-3'""")
def j13(spark, sf_dir):
    w, base = _windows(spark, sf_dir)
    return drift.comparable_pairs(w, base.filter("model_id <> 'model-3'")).select(
        "model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"), "n", "successes",
        F.col("base_successes").cast("long").alias("base_successes"),
        F.col("base_n").cast("long").alias("base_n"))


def p_value_sql(s1, n1, s0, n0):
    pooled = f"(({s1} + {s0}) / cast({n1} + {n0} as double))"
    spread = f"sqrt({pooled} * (1 - {pooled}) * (1e0 / {n1} + 1e0 / {n0}))"
    z = f"abs(({s1} / cast({n1} as double) - {s0} / cast({n0} as double)) / {spread})"
    return f"(case when {spread} = 0 then 1e0 else least(1e0, 2 * {stats.upper_tail_sql(z)}) end)"


@query("A26_two_proportion_p", f"""
with {WEEKS_SQL}
select model_id, cluster_id, cast(epoch_us(ts) as bigint) as ts_us,
  round({p_value_sql('successes', 'n', 's0', 'n0')}, 9) as p_value
from WN join BL using (model_id, cluster_id)""")
def a26(spark, sf_dir):
    rows = drift.comparable_pairs(*_windows(spark, sf_dir))
    p = stats.two_proportion_p(F.col("successes"), F.col("n"), F.col("base_successes"),
                               F.col("base_n"))
    return rows.select("model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"),
                       num(p, "p_value", 9))


_ZA, _ZB = stats.ppf_sql("(1.0e0 - alpha)"), stats.ppf_sql("8.0e-1")


@query("A27_sample_size_power", f"""
with {ad.LINEITEM_SQL},
C as (select model_id, template, count(*) as n,
    count(*) filter (where status = 'pass') / cast(count(*) as double) as p from L group by all),
G as (select model_id, template, n, p, d, 5.0e-2 as alpha, (p + p - d) / 2 as mid, p - d as p2
      from C, (select unnest([0.02e0, 0.05e0, 0.1e0]) as d) where d < p)
select model_id, template, d,
  cast(ceil(power({_ZA} * sqrt(2 * mid * (1 - mid)) + {_ZB} * sqrt(p*(1-p) + p2*(1-p2)), 2)
       / (d * d)) as bigint) as per_arm,
  round(1 - {stats.upper_tail_sql('g')}, 6) as power
from (select G.*, abs((d - {_ZA} * sqrt(2*mid*(1-mid)/n)) / sqrt((p*(1-p) + p2*(1-p2))/n)) as g0,
        (d - {_ZA} * sqrt(2*mid*(1-mid)/n)) / sqrt((p*(1-p) + p2*(1-p2))/n) as g1, g0 as g from G)
where g1 >= 0
union all
select model_id, template, d,
  cast(ceil(power({_ZA} * sqrt(2 * mid * (1 - mid)) + {_ZB} * sqrt(p*(1-p) + p2*(1-p2)), 2)
       / (d * d)) as bigint) as per_arm,
  round({stats.upper_tail_sql('g')}, 6) as power
from (select G.*, abs((d - {_ZA} * sqrt(2*mid*(1-mid)/n)) / sqrt((p*(1-p) + p2*(1-p2))/n)) as g,
        (d - {_ZA} * sqrt(2*mid*(1-mid)/n)) / sqrt((p*(1-p) + p2*(1-p2))/n) as g1 from G)
where g1 < 0""")
def a27(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir)
    rates = a.groupBy(
        "model_id", F.col("input_shape.system_prompt_fingerprint").alias("template")
    ).agg(F.count(F.lit(1)).alias("n"),
          F.avg((F.col("verification.status") == "pass").cast("double")).alias("p"))
    design = rates.withColumn("d", F.explode(F.array(F.lit(0.02), F.lit(0.05), F.lit(0.1))))
    return design.filter(F.col("d") < F.col("p")).select(
        "model_id", "template", "d",
        stats.sample_size(F.col("p"), F.col("d")).alias("per_arm"),
        num(stats.power(F.col("n"), F.col("p"), F.col("d")), "power"))


BH_SQL = """
BR as (select *, count(*) over () as m,
    rank() over (order by p) + count(*) over (partition by p) - 1 as rk from PV),
BC as (select *, coalesce(max(case when p <= rk / cast(m as double) * {q} then rk end) over (), 0)
        as cut,
      least(1e0, min(p * m / rk) over (order by p range between current row and unbounded following))
        as q_value from BR)"""


@query("A28_benjamini_hochberg", f"""
with {WEEKS_SQL},
PV as (select model_id, cluster_id, ts, {p_value_sql('successes', 'n', 's0', 'n0')} as p
       from WN join BL using (model_id, cluster_id)), {BH_SQL.format(q='0.05e0')}
select model_id, cluster_id, cast(epoch_us(ts) as bigint) as ts_us, round(q_value, 9) as q_value,
  rk <= cut as rejected from BC""")
def a28(spark, sf_dir):
    rows = drift.comparable_pairs(*_windows(spark, sf_dir)).withColumn(
        "p", stats.two_proportion_p(F.col("successes"), F.col("n"), F.col("base_successes"),
                                    F.col("base_n")))
    return drift.benjamini_hochberg(rows, "p").select(
        "model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"), num("q_value", "q_value", 9),
        "rejected")


CUSUM_SQL = """
CU as (select *, sum(s0 / cast(n0 as double) - successes / cast(n as double) - 0.025e0)
        over (partition by model_id, cluster_id order by ts rows unbounded preceding) as c
       from WN join BL using (model_id, cluster_id)),
CS as (select *, c - least(0e0, min(c) over (partition by model_id, cluster_id order by ts
                                             rows unbounded preceding)) as s from CU)"""


@query("W4_cusum", f"""
with recursive {WEEKS_SQL.strip()},
D as (select model_id, cluster_id, ts, s0 / cast(n0 as double) - successes / cast(n as double)
        - 0.025e0 as d,
      row_number() over (partition by model_id, cluster_id order by ts) as i
      from WN join BL using (model_id, cluster_id)),
R(model_id, cluster_id, ts, i, s) as (
  select model_id, cluster_id, ts, i, greatest(0e0, d) from D where i = 1
  union all
  select D.model_id, D.cluster_id, D.ts, D.i, greatest(0e0, R.s + D.d)
  from R join D on D.model_id = R.model_id and D.cluster_id = R.cluster_id and D.i = R.i + 1)
select model_id, cluster_id, cast(epoch_us(ts) as bigint) as ts_us, round(s, 9) as cusum,
  max(s) over (partition by model_id, cluster_id order by ts rows unbounded preceding) > 0.3e0
    as crossed from R""")
def w4(spark, sf_dir):
    rows = drift.comparable_pairs(*_windows(spark, sf_dir)).withColumn(
        "rate", F.col("successes") / F.col("n")).withColumn(
        "target", F.col("base_successes") / F.col("base_n"))
    out = drift.cusum(rows, "rate", "target", drift=0.05, h=0.3, by=drift.PAIR, order=["ts"])
    return out.select("model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"),
                      num("cusum", "cusum", 9), F.col("cusum_crossed").alias("crossed"))


@query("A29_detect_drift", f"""
with {WEEKS_SQL}, {CUSUM_SQL},
DN as (select *, s0 / cast(n0 as double) as p0, successes / cast(n as double) as p1,
    successes / cast(n as double) - s0 / cast(n0 as double) as d,
    {wilson_sql('successes', 'n', 'low')} as l1, {wilson_sql('successes', 'n', 'high')} as h1,
    {wilson_sql('s0', 'n0', 'low')} as l0, {wilson_sql('s0', 'n0', 'high')} as h0 from CS),
DC as (select *, {NEWCOMBE_SQL.replace('6)', '12)')} from DN),
DD as (select *, ci_high < 0 and abs((p1 - p0) * 100) > 5 as is_drop from DC),
DW as (select *, lag(is_drop) over w as prev_drop, lag(ts) over w as prev_ts,
    max(s > 0.5e0) over (w rows unbounded preceding) as crossed,
    row_number() over (partition by model_id, cluster_id order by ts desc) as back
  from DD window w as (partition by model_id, cluster_id order by ts)),
PV as (select *, {p_value_sql('successes', 'n', 's0', 'n0')} as p from DW where back = 1),
{BH_SQL.format(q='0.05e0')}
select model_id, cluster_id, round(p0, 6) as baseline_rate, round(p1, 6) as current_rate,
  round_even((p1 - p0) * 100, 1) as delta_points, round_even(ci_low * 100, 1) as ci_low_points,
  round_even(ci_high * 100, 1) as ci_high_points, n,
  cast(case when prev_drop then 2 else 1 end as bigint) as confirmed_windows, crossed as cusum_crossed,
  round_even(q_value, 3) as q_value,
  cast(epoch_us(case when prev_drop then prev_ts else ts end) as bigint) as first_us
from BC where is_drop and (coalesce(prev_drop, false) or crossed) and rk <= cut""")
def a29(spark, sf_dir):
    w, base = _windows(spark, sf_dir)
    return drift.detect_drift(base, w).select(
        "model_id", "cluster_id", num("baseline_rate", "baseline_rate"),
        num("current_rate", "current_rate"), "delta_points", "ci_low_points", "ci_high_points", "n",
        F.col("confirmed_windows").cast("long").alias("confirmed_windows"), "cusum_crossed",
        "q_value", F.unix_micros("first_observed").alias("first_us"))
