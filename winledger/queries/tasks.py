"""Tasks and core metrics."""

from pyspark.sql import functions as F

from winledger.functions import stats
from winledger.operators import metrics, report, tasks
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query

EVENT_GAP_S = 21600


def lineitem_tasks(spark, sf_dir):
    return tasks.assemble_tasks(ad.attempts_from_lineitem(spark, sf_dir))


def event_tasks(spark, sf_dir):
    return tasks.assemble_tasks(ad.attempts_from_events(spark, sf_dir), gap_s=EVENT_GAP_S)


EVENT_CHAINS_SQL = ad.EVENTS_SQL + f""",
EW as (
  select E.*, lag(ts_end) over w as prev_end, lag(template) over w as prev_template
  from E window w as (partition by session_id order by ts_start, trace_id)),
EN as (
  select EW.*, case when prev_end is not null and prev_template = template
      and epoch_us(ts_start) - epoch_us(prev_end) < {EVENT_GAP_S * 1000000} then 0 else 1 end as opens
  from EW),
EG as (
  select EN.*, sum(opens) over (partition by session_id order by ts_start, trace_id
                                rows unbounded preceding) as grp from EN),
EC as (
  select EG.*, first_value(trace_id) over (partition by session_id, grp
                                           order by ts_start, trace_id) as task_key from EG)"""

EVENT_TASKS_SQL = EVENT_CHAINS_SQL + """,
EM as (select task_key, model_id, min((ts_start, trace_id)) as first_at from EC group by all),
EMO as (select task_key, list(model_id order by first_at) as models from EM group by all),
ET as (
  select task_key as task_id, count(*) as attempts, bool_or(status = 'pass') as succeeded,
    arg_min(status, (ts_start, trace_id)) = 'pass' as first_ok, sum(cost) as cost,
    cast(sum(wall) as bigint) as wall, cast(sum(tok_in) as bigint) as tok_in,
    cast(sum(reasoning) as bigint) as tok_think,
    bool_or(status <> 'unknown') as known, min(ts_start) as ts_start, max(ts_end) as ts_end
  from EC group by task_key),
ETM as (select ET.*, models, models[-1] as finisher from ET join EMO on task_id = task_key)"""



def wilson_sql(s: str, n: str, side: str) -> str:
    """Wilson bound as SQL; z = 1.96."""
    p = f"(cast({s} as double) / {n})"
    z2 = "3.8416e0"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = (
        f"((1.96e0 / (1 + {z2} / {n})) * sqrt({p} * (1 - {p}) / {n} "
        f"+ {z2} / (4e0 * {n} * {n})))"
    )
    if side == "low":
        body = f"least({p}, greatest(0e0, {centre} - {half}))"
    else:
        body = f"greatest({p}, least(1e0, {centre} + {half}))"
    return f"(case when {n} > 0 then {body} end)"


CORE_SQL = f"""
  count(*) as n_tasks, count(*) filter (where known) as n_verified,
  count(*) - count(*) filter (where known) as n_unknown,
  count(*) filter (where known and succeeded) as wins,
  cast(sum(case when known then cost end) as double) as cost_sum,
  sum(case when known then wall end) / 1000e0 as wall_sum,
  sum(case when known then attempts end) as attempts_sum"""

CORE_OUT_SQL = f"""
  n_tasks, n_verified, n_unknown, wins,
  round(wins / nullif(cast(n_verified as double), 0), 6) as success_rate,
  round({wilson_sql('wins', 'n_verified', 'low')}, 6) as ci_low,
  round({wilson_sql('wins', 'n_verified', 'high')}, 6) as ci_high,
  round(n_unknown / cast(n_tasks as double), 6) as unknown_rate,
  round(cost_sum / nullif(wins, 0), 8) as cpat,
  round(wall_sum / nullif(wins, 0), 6) as ttat,
  round(attempts_sum / nullif(cast(wins as double), 0), 6) as attempts_per_win"""


def core_columns():
    return [
        "n_tasks", "n_verified", "n_unknown",
        F.col("cpat_usd.n_successes").alias("wins"),
        num("success_rate.value", "success_rate"),
        num("success_rate.ci_low", "ci_low"),
        num("success_rate.ci_high", "ci_high"),
        num("unknown_rate.value", "unknown_rate"),
        num("cpat_usd.value", "cpat", 8),
        num("ttat_seconds.value", "ttat"),
        num("attempts_per_win.value", "attempts_per_win"),
    ]


@query("A1_assemble_tasks", f"""
with {ad.LINEITEM_TASKS_SQL}
select tenant_id, task_id, attempts, succeeded, first_ok as first_attempt_success,
  cast(cost as double) as total_cost_usd, wall as total_wall_ms, tok_in, tok_out, tok_think,
  array_to_string(models, ',') as models_used, grade as verification_grade,
  finisher as finishing_model, first_trace_id, cast(failed_n as bigint) as failed_attempts,
  cast(failed_cost as double) as failed_cost_usd, cast(epoch_us(ts_start) as bigint) as start_us
from LT""")
def a1(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    return t.select(
        "tenant_id", "task_id", "attempts", "succeeded", "first_attempt_success",
        F.col("total_cost_usd").cast("double").alias("total_cost_usd"), "total_wall_ms",
        F.col("total_tokens.input").alias("tok_in"), F.col("total_tokens.output").alias("tok_out"),
        F.col("total_tokens.reasoning").alias("tok_think"),
        F.array_join("models_used", ",").alias("models_used"), "verification_grade",
        "finishing_model", "first_trace_id", "failed_attempts",
        F.col("failed_cost_usd").cast("double").alias("failed_cost_usd"),
        F.unix_micros("ts_start").alias("start_us"),
    )


@query("A1_assemble_chained", f"""
with {EVENT_TASKS_SQL}
select task_id, attempts, succeeded, first_ok as first_attempt_success,
  cast(cost as double) as total_cost_usd, wall as total_wall_ms, tok_in, tok_think,
  array_to_string(models, ',') as models_used,
  case when known then 'measured' else 'unknown' end as verification_grade
from ETM""")
def a1_chained(spark, sf_dir):
    t, _ = event_tasks(spark, sf_dir)
    return t.select(
        "task_id", "attempts", "succeeded", "first_attempt_success",
        F.col("total_cost_usd").cast("double").alias("total_cost_usd"), "total_wall_ms",
        F.col("total_tokens.input").alias("tok_in"),
        F.col("total_tokens.reasoning").alias("tok_think"),
        F.array_join("models_used", ",").alias("models_used"), "verification_grade",
    )


@query("W1_chain_attempts", f"with {EVENT_CHAINS_SQL} select trace_id, task_key from EC")
def w1(spark, sf_dir):
    return tasks.chain_attempts(
        ad.attempts_from_events(spark, sf_dir), gap_s=EVENT_GAP_S
    ).select("trace_id", "task_key")


SHINGLES_SQL = """
  [concat('a', user_id), concat('b', user_id % 7), concat('c', user_id % 5), concat('d', k % 2),
   concat('e', user_id % 3), concat('f', user_id % 2), concat('g', user_id % 11),
   concat('h', user_id % 13), concat('i', user_id % 17), concat('j', user_id % 19)]"""


@query("W1_chain_with_shingles", f"""
with {ad.EVENTS_SQL},
S as (select E.*, {SHINGLES_SQL} as sh from E),
SW as (select S.*, lag(ts_end) over w as pe, lag(template) over w as pt, lag(sh) over w as ps
       from S window w as (partition by session_id order by ts_start, trace_id)),
SN as (select SW.*, case when pe is not null and pt = template
    and epoch_us(ts_start) - epoch_us(pe) < {EVENT_GAP_S * 1000000}
    and len(list_intersect(ps, sh)) / cast(len(list_distinct(list_concat(ps, sh))) as double) > 0.8
    then 0 else 1 end as opens from SW),
SG as (select SN.*, sum(opens) over (partition by session_id order by ts_start, trace_id
                                     rows unbounded preceding) as grp from SN)
select trace_id, first_value(trace_id) over (partition by session_id, grp
                                             order by ts_start, trace_id) as task_key from SG""")
def w1_shingles(spark, sf_dir):
    return tasks.chain_attempts(
        ad.attempts_from_events(spark, sf_dir, shingles=True), gap_s=EVENT_GAP_S
    ).select("trace_id", "task_key")


@query("W2_jaccard", f"""
with {ad.EVENTS_SQL},
S as (select E.*, {SHINGLES_SQL} as sh from E),
SW as (select trace_id, sh, lag(sh) over (partition by session_id order by ts_start, trace_id) as ps
       from S)
select trace_id, case when ps is null then 1e0 else round(len(list_intersect(ps, sh))
  / cast(len(list_distinct(list_concat(ps, sh))) as double), 6) end as overlap from SW""")
def w2(spark, sf_dir):
    from winledger.plans.ordered import scan

    a = ad.attempts_from_events(spark, sf_dir, shingles=True)
    linked = scan(a, tasks.SESSION, tasks.IN_TIME, lag={"prev": F.col("input_shingles")})
    return linked.select(
        "trace_id", num(tasks.jaccard(F.col("prev"), F.col("input_shingles")), "overlap")
    )


@query("J2_link_attempts", f"""
with {ad.EVENTS_SQL}
select trace_id, lag(trace_id) over w as prev_trace_id, lead(trace_id) over w as next_trace_id,
  round((epoch_us(ts_start) - lag(epoch_us(ts_end)) over w) / 1e6, 6) as prev_gap_s,
  round((lead(epoch_us(ts_start)) over w - epoch_us(ts_end)) / 1e6, 6) as next_gap_s,
  coalesce(lead(template) over w = template
    and lead(epoch_us(ts_start)) over w - epoch_us(ts_end) <= 600000000, false)
    as retried_within_10m
from E window w as (partition by session_id order by ts_start, trace_id)""")
def j2(spark, sf_dir):
    return tasks.link_attempts(ad.attempts_from_events(spark, sf_dir)).select(
        "trace_id", "prev_trace_id", "next_trace_id", num("prev_gap_s", "prev_gap_s"),
        num("next_gap_s", "next_gap_s"), "retried_within_10m",
    )


REP_SQL = """
LR as (
  select tenant_id, task_id,
    arg_max(trace_id, (case when status = 'pass' then 1 else 0 end, ts_start, trace_id)) as rep_id
  from L group by all)"""


@query("W5_representative", f"""
with {ad.LINEITEM_SQL}, {REP_SQL}
select tenant_id, task_id, rep_id as trace_id from LR""")
def w5(spark, sf_dir):
    _, rows = lineitem_tasks(spark, sf_dir)
    return tasks.representative(rows, {"trace_id": F.col("trace_id")}).select("tenant_id", "task_id", "trace_id")


@query("A2_core_metrics", f"""
with {ad.LINEITEM_TASKS_SQL}, M as (select tenant_id, {CORE_SQL} from LT group by tenant_id)
select tenant_id, {CORE_OUT_SQL} from M""")
def a2(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    return metrics.core_metrics(t, by=["tenant_id"]).select("tenant_id", *core_columns())


@query("A3_core_metrics_by_model", f"""
with {ad.LINEITEM_TASKS_SQL}, M as (select finisher as model_id, {CORE_SQL} from LT group by finisher)
select model_id, {CORE_OUT_SQL} from M""")
def a3(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    return metrics.core_metrics_by_model(t).select("model_id", *core_columns())


@query("A3_core_metrics_levels", f"""
with {ad.LINEITEM_TASKS_SQL},
M as (select finisher as model_id, tenant_id as cluster_id, {CORE_SQL} from LT
      group by grouping sets ((finisher), (tenant_id), (finisher, tenant_id), ()))
select model_id, cluster_id, {CORE_OUT_SQL} from M""")
def a3_levels(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    named = t.withColumn("model_id", F.col("finishing_model")).withColumn(
        "cluster_id", F.col("tenant_id"))
    levels = [["model_id"], ["cluster_id"], ["model_id", "cluster_id"], []]
    return metrics.core_metrics_levels(named, levels).select(
        "model_id", "cluster_id", *core_columns())


@query("A4_wilson", f"""
with {ad.LINEITEM_SQL},
C as (select template, model_id, count(*) filter (where status = 'pass') as s, count(*) as n
      from L group by all)
select template, model_id, s, n, round({wilson_sql('s', 'n', 'low')}, 9) as low,
  round({wilson_sql('s', 'n', 'high')}, 9) as high from C""")
def a4(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir)
    c = a.groupBy(F.col("input_shape.system_prompt_fingerprint").alias("template"),
                  "model_id").agg(
        F.count_if(F.col("verification.status") == "pass").alias("s"), F.count(F.lit(1)).alias("n"))
    ci = stats.wilson(F.col("s"), F.col("n"))
    return c.select("template", "model_id", "s", "n", num(ci["low"], "low", 9),
                    num(ci["high"], "high", 9))


NEWCOMBE_SQL = f"""
  round(greatest(-1e0, d - sqrt(power(p1 - l1, 2) + power(h0 - p0, 2))), 6) as ci_low,
  round(least(1e0, d + sqrt(power(h1 - p1, 2) + power(p0 - l0, 2))), 6) as ci_high"""


@query("A5_newcombe", f"""
with {ad.LINEITEM_SQL},
C as (select template, count(*) filter (where status = 'pass' and model_id = 'model-1') as s1,
        count(*) filter (where model_id = 'model-1') as n1,
        count(*) filter (where status = 'pass' and model_id = 'model-0') as s0,
        count(*) filter (where model_id = 'model-0') as n0 from L group by template),
D as (select *, s1 / cast(n1 as double) as p1, s0 / cast(n0 as double) as p0,
        s1 / cast(n1 as double) - s0 / cast(n0 as double) as d,
        {wilson_sql('s1', 'n1', 'low')} as l1, {wilson_sql('s1', 'n1', 'high')} as h1,
        {wilson_sql('s0', 'n0', 'low')} as l0, {wilson_sql('s0', 'n0', 'high')} as h0 from C)
select template, {NEWCOMBE_SQL} from D""")
def a5(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir)
    ok, m = F.col("verification.status") == "pass", F.col("model_id")
    c = a.groupBy(F.col("input_shape.system_prompt_fingerprint").alias("template")).agg(
        F.count_if(ok & (m == "model-1")).alias("s1"), F.count_if(m == "model-1").alias("n1"),
        F.count_if(ok & (m == "model-0")).alias("s0"), F.count_if(m == "model-0").alias("n0"))
    ci = stats.newcombe(F.col("s1"), F.col("n1"), F.col("s0"), F.col("n0"))
    return c.select("template", num(ci["low"], "ci_low"), num(ci["high"], "ci_high"))


@query("A22_model_inventory", f"""
with {ad.LINEITEM_TASKS_SQL}, U as (select unnest(models) as model_id, known from LT)
select model_id, count(*) as n_tasks, count(*) filter (where known) as n_verified
from U group by model_id""")
def a22(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    return report.model_inventory(t)


@query("A40_majority_model", f"""
with {ad.LINEITEM_TASKS_SQL}, C as (select finisher, count(*) as n from LT group by finisher)
select finisher as from_model, n as n_tasks from C order by n desc, finisher limit 1""")
def a40(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    return report.majority_model(t)
