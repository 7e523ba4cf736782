"""Taxonomy and pack sections."""

from pyspark.sql import functions as F

from winledger.operators import cluster, pack, tasks
from winledger.plans import adapters as ad
from winledger.plans.ordered import stored
from winledger.queries import cnt, num, query
from winledger.queries.tasks import lineitem_tasks


def clustered(spark, sf_dir):
    """Order tasks in seven given clusters. Tasks are written once: each operator reads them several times."""
    t, rows = lineitem_tasks(spark, sf_dir)
    t = stored(t)
    k = F.concat(F.lit("k"), (F.col("task_id").cast("long") % 7).cast("string"))
    given = t.select("tenant_id", "task_id", k.alias("cluster_id"))
    return tasks.attach_clusters(t, given), rows


CL = "concat('k', cast(task_id as bigint) % 7)"

CLUSTERED_SQL = ad.LINEITEM_TASKS_SQL + f""",
LC as (select LT.*, {CL} as cluster_id from LT),
LP as (
  select tenant_id, task_id, arg_max({{'trace_id': trace_id, 'ts_start': ts_start,
      'out_type': out_type, 'schema_fp': schema_fp, 'json_valid': json_valid,
      'out_chars': out_chars, 'tools': tools}}, (ts_start, trace_id)) as r
  from L where status = 'pass' group by all),
WIN as (select LC.cluster_id, LC.tenant_id, LC.task_id, LC.cost, r.* from LP
        join LC using (tenant_id, task_id))"""


@query("J12_attach_clusters", f"""
with {CLUSTERED_SQL}
select cluster_id, count(*) as n_tasks, cast(sum(cost) as double) as cost from LC group by all""")
def j12(spark, sf_dir):
    t, _ = clustered(spark, sf_dir)
    return t.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("total_cost_usd").cast("double").alias("cost"))


@query("A14_output_contract", f"""
with {CLUSTERED_SQL},
TC as (select cluster_id, out_type, count(*) as n, min((ts_start, trace_id)) as f from WIN group by all),
SC as (select cluster_id, schema_fp, count(*) as n, min((ts_start, trace_id)) as f from WIN
       where schema_fp is not null group by all),
T1 as (select cluster_id, arg_min(out_type, (-n, f)) as dominant_type from TC group by all),
S1 as (select cluster_id, arg_min(schema_fp, (-n, f)) as schema_fp, max(n) as sn from SC group by all),
C as (select cluster_id, count(*) as n,
    count(*) filter (where json_valid) / cast(count(*) as double) as jr,
    count(*) filter (where out_type = 'json') / cast(count(*) as double) as share_json,
    count(*) filter (where out_type = 'mixed') / cast(count(*) as double) as share_mixed,
    list_sort(list(out_chars)) as lens from WIN group by all)
select cluster_id, n as n_successes, dominant_type, schema_fp as dominant_schema,
  round(sn / cast(n as double), 6) as dominant_schema_share, round(jr, 6) as json_valid_rate,
  round(share_json, 6) as share_json, round(share_mixed, 6) as share_mixed,
  lens[least(n - 1, cast(floor(0.1e0 * n) as bigint)) + 1] as p10,
  lens[least(n - 1, cast(floor(0.5e0 * n) as bigint)) + 1] as p50,
  lens[least(n - 1, cast(floor(0.9e0 * n) as bigint)) + 1] as p90
from C join T1 using (cluster_id) left join S1 using (cluster_id)""")
def a14(spark, sf_dir):
    c = pack.output_contract(*clustered(spark, sf_dir))
    return c.select(
        "cluster_id", "n_successes", "dominant_type",
        F.col("dominant_schema_fingerprint").alias("dominant_schema"),
        num("dominant_schema_share", "dominant_schema_share"),
        num("json_valid_rate", "json_valid_rate"),
        num(F.coalesce(F.try_element_at("type_shares", F.lit("json")), F.lit(0.0)), "share_json"),
        num(F.coalesce(F.try_element_at("type_shares", F.lit("mixed")), F.lit(0.0)), "share_mixed"),
        "length.p10", "length.p50", "length.p90")


@query("A15_percentiles", """
with S as (select lang, list_sort(list(n_chars)) as v, count(*) as n from documents group by lang)
select lang, v[least(n - 1, cast(floor(0.1e0 * n) as bigint)) + 1] as p10,
  v[least(n - 1, cast(floor(0.5e0 * n) as bigint)) + 1] as p50,
  v[least(n - 1, cast(floor(0.9e0 * n) as bigint)) + 1] as p90 from S""")
def a15(spark, sf_dir):
    return pack.nearest_rank_percentiles(
        ad.table(spark, sf_dir, "documents"), "n_chars", ["lang"], [0.1, 0.5, 0.9])


@query("A16_json_fields", """
with F as (select event_type, unnest(json_keys(props)) as name, props from events),
N as (select event_type, count(*) as n from events group by all)
select event_type, name, round(count(*) / cast(any_value(n) as double), 6) as presence,
  'int' as types from F join N using (event_type) group by all""")
def a16(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return pack.json_fields(e, ["event_type"], text="props").select(
        "event_type", "name", num("presence", "presence"), F.array_join("types", ",").alias("types"))


@query("A17_edge_cases", f"""
with {CLUSTERED_SQL},
TC as (select cluster_id, out_type, count(*) as n, min((ts_start, trace_id)) as f from WIN group by all),
SC as (select cluster_id, schema_fp, count(*) as n, min((ts_start, trace_id)) as f from WIN
       where schema_fp is not null group by all),
T1 as (select cluster_id, arg_min(out_type, (-n, f)) as dt from TC group by all),
S1 as (select cluster_id, arg_min(schema_fp, (-n, f)) as ds from SC group by all),
C as (select cluster_id, count(*) as n, list_sort(list(out_chars)) as v from WIN group by all),
B as (select cluster_id, v[least(n - 1, cast(floor(0.1e0 * n) as bigint)) + 1] as p10,
        v[least(n - 1, cast(floor(0.9e0 * n) as bigint)) + 1] as p90 from C),
D as (select WIN.cluster_id, task_id, cost, unnest(list_concat(
    case when out_type <> dt then ['type_mismatch'] else [] end,
    case when schema_fp <> ds then ['schema_mismatch'] else [] end,
    case when not (out_chars between p10 and p90) then ['length_outlier'] else [] end)) as signature
  from WIN join T1 using (cluster_id) left join S1 using (cluster_id) join B using (cluster_id)),
G as (select cluster_id, signature, count(*) as n_tasks, cast(sum(cost) as double) as cost,
    array_to_string(list(task_id order by task_id)[1:3], ',') as examples from D group by all)
select cluster_id, signature, n_tasks, cost as total_cost_usd, examples,
  row_number() over (partition by cluster_id order by n_tasks * cost desc, signature) as rank
from G""")
def a17(spark, sf_dir):
    t, rows = clustered(spark, sf_dir)
    e = pack.edge_cases(t, rows, pack.output_contract(t, rows))
    return e.select("cluster_id", "signature", "n_tasks",
                    F.col("total_cost_usd").cast("double").alias("total_cost_usd"),
                    F.array_join("example_task_ids", ",").alias("examples"), cnt("rank", "rank"))


@query("A18_tool_frequencies", f"""
with {CLUSTERED_SQL}, N as (select cluster_id, count(*) as n from WIN group by all),
U as (select cluster_id, task_id, unnest(list_distinct(tools)) as tool from WIN)
select cluster_id, tool, count(*) as n_tasks, round(count(*) / cast(any_value(n) as double), 6) as share
from U join N using (cluster_id) group by all""")
def a18(spark, sf_dir):
    return pack.tool_frequencies(*clustered(spark, sf_dir)).select(
        "cluster_id", "tool", "n_tasks", num("share", "share"))


@query("A19_tool_transitions", f"""
with {CLUSTERED_SQL},
S as (select cluster_id, unnest(range(1, len(tools))) as i, tools from WIN where len(tools) > 1),
C as (select cluster_id, tools[i] as src, tools[i + 1] as dst, count(*) as n from S group by all)
select cluster_id, src, dst, n as count,
  round(n / sum(n) over (partition by cluster_id, src), 6) as probability from C""")
def a19(spark, sf_dir):
    return pack.tool_transitions(*clustered(spark, sf_dir)).select(
        "cluster_id", "src", "dst", "count", num("probability", "probability"))


@query("A20_tool_order", f"""
with {CLUSTERED_SQL},
U as (select cluster_id, task_id, tools, unnest(list_distinct(tools)) as tool from WIN),
Q as (select cluster_id, task_id, tool, list_position(tools, tool) as pos from U),
X as (select a.cluster_id, a.tool as "before", b.tool as "after", count(*) as support,
    bool_and(a.pos < b.pos) as holds
  from Q a join Q b on a.cluster_id = b.cluster_id and a.task_id = b.task_id and a.tool <> b.tool
  group by all)
select cluster_id, "before", "after", support, round(support / cast(support + 1 as double), 6)
  as confidence from X where holds and support >= 3""")
def a20(spark, sf_dir):
    return pack.tool_order(*clustered(spark, sf_dir)).select(
        "cluster_id", "before", "after", "support", num("confidence", "confidence"))


@query("A21_template_refs", f"""
with {CLUSTERED_SQL}
select distinct cluster_id, concat('template://', template) as ref
from L join LC using (tenant_id, task_id)""")
def a21(spark, sf_dir):
    return pack.template_refs(*clustered(spark, sf_dir))


@query("W3_golden_set", f"""
with {CLUSTERED_SQL},
GP as (select tenant_id, task_id, arg_max({{'trace_id': trace_id, 'chars': out_chars}},
         (ts_start, trace_id)) as r
       from L where status = 'pass' and grade_no = 0 group by all),
E1 as (select LC.cluster_id, tenant_id, task_id, r.trace_id, r.chars, cost from GP
       join LC using (tenant_id, task_id)),
S as (select cluster_id, count(*) as size from LC group by all),
M as (select cluster_id, count(*) as m, any_value(size) as size,
        greatest(30, cast(ceil(0.03e0 * any_value(size)) as bigint)) as target
      from E1 join S using (cluster_id) group by all),
R as (select E1.*, m, target, cast(ceil(m / 3e0) as bigint) as block,
        row_number() over (partition by cluster_id order by cost, task_id, tenant_id) as rk
      from E1 join M using (cluster_id)),
T as (select *, (rk - 1) // block as stratum from R),
P as (select *, row_number() over (partition by cluster_id, stratum order by chars, rk) - 1 as pos,
        count(*) over (partition by cluster_id, stratum) as sz,
        target // 3 + case when stratum < target % 3 then 1 else 0 end as quota from T),
K as (select P.*, list_transform(range(0, quota),
        lambda i: least(sz - 1, cast(floor(i * (sz / cast(quota as double))) as bigint))) as picks from P)
select cluster_id, tenant_id, task_id as case_id, concat('trace://', trace_id, '/input') as input_ref,
  cast(cost as double) as cost_usd, chars as output_n_chars
from K where m <= target or quota >= sz or list_contains(picks, pos)""")
def w3(spark, sf_dir):
    return pack.golden_set(*clustered(spark, sf_dir)).select(
        "cluster_id", "tenant_id", "case_id", "input_ref",
        F.col("cost_usd").cast("double").alias("cost_usd"), "output_n_chars")


def features(spark, sf_dir):
    t, rows = lineitem_tasks(spark, sf_dir)
    return t, cluster.task_features(tasks.representative(rows, cluster.needed()))


FEATURES_SQL = ad.LINEITEM_SQL + """,
FT as (
  select tenant_id, task_id, r.template, r.out_type, r.json_valid, r.has_code,
    case when len(r.tools) > 0 then array_to_string(r.tools, '>') else '<none>' end as tool_sig,
    ln(1 + cast(r.out_chars as double)) / 10 as len
  from (select tenant_id, task_id, arg_max({'template': template, 'out_type': out_type,
          'json_valid': json_valid, 'has_code': has_code, 'tools': tools, 'out_chars': out_chars},
          (case when status = 'pass' then 1 else 0 end, ts_start, trace_id)) as r
        from L group by all))"""


@query("C1_task_features", f"""
with {FEATURES_SQL}
select tenant_id, task_id, template, tool_sig, out_type, json_valid, has_code, round(len, 9) as len
from FT""")
def c1(spark, sf_dir):
    _, f = features(spark, sf_dir)
    return f.withColumn("len", F.round("len", 9))


def _hierarchy_sql() -> str:
    """Cells, their core levels and components, the branches kept and the label of every task (LB)."""
    lam = [d**-0.5 for d in cluster.LEVELS] + [0.0]
    steps = ", ".join(f"{{'level': {i}, 'comp': c{i}, 'parent': {f'c{i + 1}' if i < 7 else 'null'}}}" for i in range(8))
    parts = "".join(f""",
D{i} as (select p.comp, p.parent, p.n * {lam[i] - lam[i + 1]!r} + case when count(c.comp) = 1 then max(c.lasts) else 0e0 end as lasts,
    case when count(c.comp) = 1 then max(c.inside) else coalesce(sum(greatest(c.lasts, c.inside)), 0e0) end as inside,
    count(c.comp) as parts
  from NO p left join {f'D{i - 1}' if i else '(select null::varchar as comp, null::varchar as parent, 0e0 as lasts, 0e0 as inside)'} c
    on c.parent = p.comp where p.level = {i} group by p.comp, p.parent, p.n)""" for i in range(8))
    look = "".join(f""",
S{i} as (select d.comp, d.parts, s.parts > 1 and d.lasts >= d.inside as kept from D{i} d join S{i + 1} s on s.comp = d.parent
  where not s.kept)""" for i in reversed(range(7)))
    kept = " union all ".join(f"select {i} as level, comp from S{i} where kept" for i in range(7))
    mine = " or ".join(f"(KE.level = {i} and KE.comp = LV.c{i})" for i in range(7))
    reach = "".join(f""",
R{i}(a, b) as (select distinct t, t from CO where core <= {i} union select R{i}.a, y.t from R{i} join CO x on x.t = R{i}.b
  and x.core <= {i} join CO y on {same} and y.core <= {i}),
G{i} as (select a as t, concat('g', min(b)) as g{i} from R{i} group by all)""" for i, same in (
        (4, "y.s = x.s and y.h = x.h"), (5, "y.s = x.s"), (6, "(y.s = x.s or y.h = x.h)")))
    return f"""{FEATURES_SQL},
CE as (select template as t, tool_sig as s, concat_ws('|', out_type, json_valid, has_code) as h, out_type, json_valid, has_code,
    count(*) as n, sum(len) as ls from FT group by all),
MA as (select *, sum(n) over (partition by t) as mt, sum(n) over (partition by s) as ms, sum(n) over (partition by h) as mh,
    sum(n) over (partition by t, s) as mts, sum(n) over (partition by t, h) as mth, sum(n) over (partition by s, h) as msh,
    greatest(5, sum(n) over () // 100) as k from CE),
CO as (select *, case when n >= k then 0 when mts >= k then 1 when mts + mth - n >= k then 2 when mt >= k then 3
    when mt + msh - n >= k then 4 when mt + ms - mts >= k then 5 when mt + ms - mts + mh - mth - msh + n >= k then 6
    else 7 end as core from MA),
R2(t, a, b) as (select distinct t, s, s from CO where core <= 2 union select R2.t, R2.a, y.s from R2 join CO x
  on x.t = R2.t and x.s = R2.b and x.core <= 2 join CO y on y.t = x.t and y.h = x.h and y.core <= 2),
G2 as (select t, a as s, concat(t, '#', min(b)) as g2 from R2 group by t, a){reach},
LV as (select CO.*, case when core <= 0 then concat(t, '#', s, '#', h) end as c0, case when core <= 1 then concat(t, '#', s) end as c1,
    case when core <= 2 then g2 end as c2, case when core <= 3 then t end as c3, case when core <= 4 then g4 end as c4,
    case when core <= 5 then g5 end as c5, case when core <= 6 then g6 end as c6, 'all' as c7
  from CO left join G2 using (t, s) left join G4 using (t) left join G5 using (t) left join G6 using (t)),
NO as (select e.level as level, e.comp as comp, e.parent as parent, sum(n) as n
  from (select n, k, unnest([{steps}]) as e from LV) where e.comp is not null group by all having sum(n) >= any_value(k)){parts},
S7 as (select comp, parts, false as kept from D7){look},
KE as ({kept}),
OW as (select LV.*, KE.level as kl, KE.comp as kc from LV left join KE on {mine}),
LA as (select kl, kc, row_number() over (order by sum(n) desc, min((t, s, out_type, json_valid, has_code))) as label
  from OW where kc is not null group by all),
IC as (select OW.*, LA.label from OW join LA using (kl, kc)),
CN as (select label, sum(n) as cn, sum(n * json_valid::int) / sum(n) as pj, sum(n * has_code::int) / sum(n) as pc,
    sum(ls) / sum(n) as ml from IC group by label),
PT as (select label, t, sum(n) / any_value(cn) as p from IC join CN using (label) group by label, t),
PS as (select label, s, sum(n) / any_value(cn) as p from IC join CN using (label) group by label, s),
PO as (select label, out_type, sum(n) / any_value(cn) as p from IC join CN using (label) group by label, out_type),
CQ as (select CN.*, (select sum(p * p) from PT where PT.label = CN.label) as qt, (select sum(p * p) from PS where PS.label = CN.label) as qs,
    (select sum(p * p) from PO where PO.label = CN.label) as qo from CN),
FC as (select FT.*, IC.label as own from FT left join IC on IC.t = template and IC.s = tool_sig and IC.out_type = FT.out_type
    and IC.json_valid = FT.json_valid and IC.has_code = FT.has_code),
DI as (select tenant_id, task_id, CQ.label, round(9 * (1 + qt - 2 * coalesce(PT.p, 0)) + 4 * (1 + qs - 2 * coalesce(PS.p, 0))
    + (1 + qo - 2 * coalesce(PO.p, 0)) + power(json_valid::int - pj, 2) + power(has_code::int - pc, 2) + power(len - ml, 2), 9) as d
  from FC cross join CQ left join PT on PT.label = CQ.label and PT.t = template left join PS on PS.label = CQ.label and PS.s = tool_sig
    left join PO on PO.label = CQ.label and PO.out_type = FC.out_type where own is null),
LB as (select tenant_id, task_id, own as label from FC where own is not null
  union all select tenant_id, task_id, arg_min(label, (d, label)) from DI group by all)"""


HIERARCHY_SQL = _hierarchy_sql()


def merged_sql(target: int, above: int, kept: int) -> str:
    """Labels of LB merged: those beyond the ``kept`` largest into the nearest of these, then one by one (MG)."""
    return f"""
LF as (select label as l0, template, tool_sig, out_type, json_valid::int as j, has_code::int as c, len from LB join FT using (tenant_id, task_id)),
LN as (select l0, count(*) as n, sum(j) as j, sum(c) as c, sum(len) as len from LF group by l0),
LK as (select *, row_number() over (order by n desc, l0) <= {kept} as big from LN),
LD as (select l0, dim, value, w, count(*) as n from (select l0, unnest([{{'dim': 't', 'value': template, 'w': 9}},
    {{'dim': 's', 'value': tool_sig, 'w': 4}}, {{'dim': 'o', 'value': out_type, 'w': 1}}], recursive := true) from LF) group by all),
LP as (select LD.l0, dim, value, w, LD.n / LN.n as p, big from LD join LN using (l0) join LK using (l0)),
LQ as (select l0, sum(w * p * p) as q from LP group by l0),
LT0 as (select a.l0 as a, b.l0 as b, sum(a.w * a.p * b.p) as dot from LP a join LP b on a.dim = b.dim and a.value = b.value
  where not a.big and b.big group by all),
LG as (select a.l0 as a, b.l0 as b, round(qa.q + qb.q - 2 * coalesce(dot, 0) + power(a.j / a.n - b.j / b.n, 2)
    + power(a.c / a.n - b.c / b.n, 2) + power(a.len / a.n - b.len / b.n, 2), 9) as d
  from LK a join LK b on not a.big and b.big join LQ qa on qa.l0 = a.l0 join LQ qb on qb.l0 = b.l0 left join LT0 on LT0.a = a.l0 and LT0.b = b.l0),
M0 as (select l0, l0 as label from LK where big union all select a, arg_min(b, (d, b)) from LG group by a),
MR(step, l0, label) as (
  select 0, l0, case when (select count(*) from LN) > {above} then M0.label else l0 end from M0
  union all
  select step + 1, MR.l0, case when MR.label = near.small then near.into else MR.label end
  from MR, (
    with Z as (select MR.label, sum(n) as n, sum(j) as j, sum(c) as c, sum(len) as len from MR join LN using (l0) group by MR.label),
    ZV as (select MR.label, dim, value, any_value(w) as w, sum(LD.n) as n from MR join LD using (l0) group by all),
    SM as (select arg_min(label, (n, label)) as small, count(*) as many from Z),
    ZP as (select ZV.label, dim, value, w, ZV.n / Z.n as p from ZV join Z using (label)),
    ZQ as (select label, sum(w * p * p) as q from ZP group by label),
    ZD as (select a.label as label, sum(a.w * a.p * b.p) as dot from ZP a join ZP b on a.dim = b.dim and a.value = b.value
      join SM on b.label = SM.small group by a.label),
    ZG as (select Z.label, round(ZQ.q + qs.q - 2 * coalesce(dot, 0) + power(Z.j / Z.n - zs.j / zs.n, 2)
        + power(Z.c / Z.n - zs.c / zs.n, 2) + power(Z.len / Z.n - zs.len / zs.n, 2), 9) as d
      from Z join SM on Z.label <> SM.small join Z zs on zs.label = SM.small join ZQ on ZQ.label = Z.label
        join ZQ qs on qs.label = SM.small left join ZD on ZD.label = Z.label)
    select any_value(small) as small, arg_min(label, (d, label)) as into, any_value(many) as many from ZG, SM) near
  where near.many > {target} and (select count(*) from LN) > {above}),
MG as (select tenant_id, task_id, MR.label from LB join MR on MR.l0 = LB.label
  where step = (select max(step) from MR))"""


@query("C2_density_clusters", f"""
with recursive {HIERARCHY_SQL}
select tenant_id, task_id, label from LB""")
def c2(spark, sf_dir):
    _, f = features(spark, sf_dir)
    return cluster.density_clusters(f).select("tenant_id", "task_id", cnt("label", "label"))


@query("C3_merge_clusters", f"""
with recursive {HIERARCHY_SQL}, {merged_sql(8, 8, 12)}
select label, count(*) as n_tasks from MG group by label""")
def c3(spark, sf_dir):
    _, f = features(spark, sf_dir)
    merged = cluster.merge_clusters(cluster.density_clusters(f), target=8, above=8, kept=12)
    return merged.groupBy(cnt("label", "label")).agg(F.count(F.lit(1)).alias("n_tasks"))


@query("C4_rank_clusters", f"""
with {CLUSTERED_SQL},
S as (select cast(task_id as bigint) % 7 as label, count(*) as n, sum(cost) as c from LT group by all)
select concat('c', lpad(cast(row_number() over (order by c desc, label) as varchar), 2, '0'))
  as cluster_id, label, n as n_tasks, cast(c as double) as total_cost_usd,
  round(cast(c as double) / sum(cast(c as double)) over (), 6) as share_of_cost from S""")
def c4(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    given = t.select("tenant_id", "task_id", (F.col("task_id").cast("long") % 7).alias("label"))
    clusters, _ = cluster.rank_clusters(given, t)
    return clusters.select("cluster_id", "label", "n_tasks",
                           F.col("total_cost_usd").cast("double").alias("total_cost_usd"),
                           num("share_of_cost", "share_of_cost"))


@query("C_extract_clusters", f"""
with recursive {HIERARCHY_SQL}, {merged_sql(cluster.TARGET, cluster.MERGE_ABOVE, cluster.KEPT)},
TC as (select tenant_id, task_id, sum(cost) as cost from L group by all),
S as (select label, count(*) as n, sum(cost) as c from MG join TC using (tenant_id, task_id) group by label)
select concat('c', lpad(cast(row_number() over (order by c desc, label) as varchar), 2, '0')) as cluster_id, n as n_tasks,
  round(cast(c as double), 6) as cost, round(cast(c as double) / sum(cast(c as double)) over (), 6) as share_of_cost from S""")
def extract(spark, sf_dir):
    t, rows = lineitem_tasks(spark, sf_dir)
    clusters, _ = cluster.extract_clusters(t, tasks.representative(rows, cluster.needed()))
    return clusters.select("cluster_id", "n_tasks", num("total_cost_usd", "cost"),
                           num("share_of_cost", "share_of_cost"))


@query("K3_representatives", f"""
with {FEATURES_SQL},
FK as (select *, {CL} as cluster_id from FT),
N as (select cluster_id, count(*) as n, avg(len) as ml, avg(json_valid::int) as pj,
        avg(has_code::int) as pc from FK group by all),
PT as (select cluster_id, template, count(*) as c from FK group by all),
PS as (select cluster_id, tool_sig, count(*) as c from FK group by all),
PO as (select cluster_id, out_type, count(*) as c from FK group by all),
QT as (select cluster_id, sum(power(c / cast(n as double), 2)) as q from PT join N using (cluster_id) group by all),
QS as (select cluster_id, sum(power(c / cast(n as double), 2)) as q from PS join N using (cluster_id) group by all),
QO as (select cluster_id, sum(power(c / cast(n as double), 2)) as q from PO join N using (cluster_id) group by all),
D as (select cluster_id, tenant_id, task_id, round(
    9 * (1 - 2 * (PT.c / cast(n as double)) + QT.q) + 4 * (1 - 2 * (PS.c / cast(n as double)) + QS.q)
    + (1 - 2 * (PO.c / cast(n as double)) + QO.q)
    + power(json_valid::int - pj, 2) + power(has_code::int - pc, 2)
    + round(power(len - ml, 2), 9), 8) as d
  from FK join N using (cluster_id) join PT using (cluster_id, template)
    join PS using (cluster_id, tool_sig) join PO using (cluster_id, out_type)
    join QT using (cluster_id) join QS using (cluster_id) join QO using (cluster_id)),
R as (select *, row_number() over (partition by cluster_id order by d, tenant_id, task_id) as position
      from D)
select cluster_id, position, tenant_id, task_id, round(d, 6) as distance from R where position <= 5""")
def k3(spark, sf_dir):
    _, f = features(spark, sf_dir)
    k = F.concat(F.lit("k"), (F.col("task_id").cast("long") % 7).cast("string"))
    return cluster.representatives(f.withColumn("cluster_id", k)).select(
        "cluster_id", cnt("position", "position"), "tenant_id", "task_id",
        num("distance", "distance"))


@query("P23_sanitize_label", r"""
with W as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') as w
           from documents)
select doc_id, nullif(array_to_string(w[1:6], ' ')[1:60], '') as label from W""")
def p23(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    return d.select("doc_id", cluster.sanitize_label(F.col("text")).alias("label"))
