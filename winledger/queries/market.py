"""Catalogs, prices, grades, picks. Model ids are made from the part table."""

from pyspark.sql import functions as F

from winledger.functions import rules
from winledger.functions.stats import proportion
from winledger.operators import market, metrics
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query
from winledger.queries.money import CLUSTER_METRICS_SQL, _cluster_metrics
from winledger.queries.tasks import CORE_OUT_SQL, CORE_SQL, core_columns, lineitem_tasks, wilson_sql

# Stems of the model ids; the part key picks one and is appended.
STEMS = (
    "claude-opus-5", "openai/gpt-oss-120b", "gpt-4o-mini", "gemini-2.5-flash", "deepseek-chat",
    "qwen/qwen3-32b", "mistral-small", "meta-llama/llama-3.1-8b", "x-ai/grok-4.6", "acme/whisper",
    "local-model", "o3", "Google/Gemma2-9b", "allam-2-7b", "qwen/qwen3.8-27b", "openai/gpt-5",
)


def _models(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*[F.lit(s) for s in STEMS]), (k % len(STEMS) + 1).cast("int"))
    free = F.when(k % 3 == 0, ":free").otherwise("")
    return p.select(
        "*", k.alias("position"),
        F.concat(stem, F.lit("-"), k.cast("string"), free).alias("model_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("openrouter", "google", "openai", "groq")]),
                     (k % 4 + 1).cast("int")).alias("provider"),
    )


def _values(rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


MODELS_SQL = f"""
MO as (select *, p_partkey as position,
    concat(([{', '.join(repr(s) for s in STEMS)}])[p_partkey % {len(STEMS)} + 1], '-', p_partkey,
      case when p_partkey % 3 = 0 then ':free' else '' end) as model_id,
    (['openrouter','google','openai','groq'])[p_partkey % 4 + 1] as provider from part)"""


@query("J3_price_exact", f"""
with {ad.LINEITEM_SQL}, {ad.PRICES_SQL}
select L.model_id, cast(p_in as double) as p_in, p_in is null as unpriced, count(*) as n
from L left join P using (model_id) group by all""")
def j3(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir).select("model_id")
    return market.price_exact(a, ad.prices_from_nation(spark, sf_dir)).groupBy(
        "model_id", F.col("input_per_mtok").cast("double").alias("p_in"), "unpriced"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("J4_price_longest", f"""
with {MODELS_SQL},
RU as (select * from (values {_values(rules.LIST_PRICES)}) t(key, pi, po, note)),
B as (select model_id, case when model_id like '%:free' then model_id[:-6] else model_id end as paid
      from MO),
LV as (select model_id as id, p_retailprice / 1000 as pi, p_retailprice / 500 as po from MO
       where p_partkey % 9 = 1),
R as (select model_id, arg_max({{'pi': pi, 'po': po, 'note': note}}, len(key)) as r
      from B join RU on contains(lower(paid), key) group by model_id)
select B.model_id, round(coalesce(a.pi, b2.pi, cast(r.pi as double), 0.2e0), 6) as price_in,
  round(coalesce(a.po, b2.po, cast(r.po as double), 0.6e0), 6) as price_out,
  case when a.pi is not null or b2.pi is not null then 'list' else coalesce(r.note, 'estimated') end
    as note
from B left join R on R.model_id = B.model_id left join LV a on a.id = B.paid
  left join LV b2 on b2.id = B.model_id""")
def j4(spark, sf_dir):
    m = _models(spark, sf_dir)
    live = m.filter("p_partkey % 9 = 1").select(
        F.col("model_id").alias("id"), (F.col("p_retailprice") / 1000).alias("price_in"),
        (F.col("p_retailprice") / 500).alias("price_out"))
    return market.price_longest(m.select("model_id"), live).select(
        "model_id", num("price_in", "price_in"), num("price_out", "price_out"), "note")


@query("J5_price_first", f"""
with {MODELS_SQL},
RU as (select *, row_number() over () as o from (values {_values(rules.FIRST_PRICES)}) t(key, pi, po)),
R as (select model_id, arg_min({{'pi': pi, 'po': po}}, o) as r from MO join RU
      on contains(lower(model_id), key) group by model_id)
select MO.model_id, coalesce(cast(r.pi as double), 0e0) as price_in,
  coalesce(cast(r.po as double), 0e0) as price_out from MO left join R using (model_id)""")
def j5(spark, sf_dir):
    return market.price_first(_models(spark, sf_dir).select("model_id")).select(
        "model_id", num("price_in", "price_in"), num("price_out", "price_out"))


@query("J6_map_prefix", f"""
with {MODELS_SQL},
RU as (select *, row_number() over () as o from (values {_values(rules.LABS)}) t(hint, lab)),
B as (select model_id, lower(model_id) as low,
        case when contains(model_id, '/') then lower(split_part(model_id, '/', 2)) end as rest from MO),
R as (select model_id, arg_min(lab, o) as lab from B join RU on starts_with(low, hint)
        or starts_with(rest, hint) group by model_id)
select B.model_id, coalesce(lab, case when rest is not null then split_part(low, '/', 1)
    else 'unknown' end) as lab,
  case when {' or '.join(f"contains(low, '{w}')" for w in rules.SERVED_ANYWHERE)} then 'groq'
    {' '.join("when " + " or ".join(f"starts_with(low, '{w}')" for w in ws) + f" then '{p}'"
              for ws, p in rules.SERVED_PREFIXES)}
    when rest is not null then 'openrouter' else 'groq' end as provider
from B left join R using (model_id)""")
def j6(spark, sf_dir):
    return market.map_prefix(_models(spark, sf_dir).select("model_id"))


CATALOG_SQL = MODELS_SQL + """,
CU as (select provider, model_id, cast(p_partkey % 3 + case when p_partkey % 11 = 0 then 1 else 0 end
         as varchar) as v from MO where p_partkey % 5 <> 0),
KN as (select model_id, cast(p_partkey % 3 as varchar) as v from MO where p_partkey % 7 <> 0)"""


def _catalogs(spark, sf_dir):
    m, k = _models(spark, sf_dir), F.col("p_partkey")
    current = m.filter(k % 5 != 0).select(
        "provider", "model_id",
        (k % 3 + (k % 11 == 0).cast("int")).cast("string").alias("version_hint"))
    known = m.filter(k % 7 != 0).select("model_id", (k % 3).cast("string").alias("version_hint"))
    return current, known


@query("J7_diff_catalog", f"""
with {CATALOG_SQL},
D as (select coalesce(CU.model_id, KN.model_id) as model_id, coalesce(provider, 'unknown') as provider,
    case when KN.v is null then 'new' when CU.v is null then 'removed' when CU.v <> KN.v
      then 'upgraded' end as change, KN.v as previous_version, CU.v as current_version
  from CU full join KN on CU.model_id = KN.model_id)
select *, row_number() over (order by case change when 'new' then 0 when 'upgraded' then 1 else 2 end,
  model_id, provider) as ordinal from D where change is not null""")
def j7(spark, sf_dir):
    return market.diff_catalog(*_catalogs(spark, sf_dir)).select(
        "model_id", "provider", "change", "previous_version", "current_version",
        cnt("ordinal", "ordinal"))


def _retirements(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")

    def name(x):
        return F.concat(F.lit("m"), x.cast("string"))

    retire = s.select(
        F.lit("lab").alias("provider"), name(n).alias("model_id"),
        F.date_add(F.lit("2026-01-01").cast("date"), (n % 400 - 50).cast("int")).alias("retires_on"),
        F.when(n % 13 == 0, "retired").otherwise("deprecated").alias("status"),
        F.when(n % 3 == 0, F.array(name(n + 1), name(n + 2))).otherwise(
            F.array().cast("array<string>")).alias("replacements"))
    grades = s.filter(n % 4 != 0).select(name(n).alias("model_id"),
                                         (F.col("s_acctbal") / 100).alias("grade"))
    return retire, grades


@query("J9_replacement_grades", """
with G as (select concat('m', s_suppkey) as m, s_acctbal / 100 as g from supplier where s_suppkey % 4 <> 0),
O as (select concat('m', s_suppkey) as model_id, o, concat('m', s_suppkey + o + 1) as replacement
      from supplier, (select unnest([0, 1]) as o) where s_suppkey % 3 = 0)
select model_id, cast(o as bigint) as option, replacement, round(i.g, 6) as incumbent_grade,
  round(r.g, 6) as grade, round(round_even(r.g - i.g, 1), 1) as grade_delta
from O left join G i on i.m = model_id left join G r on r.m = replacement
union all select concat('m', s_suppkey), null, null, round(g, 6), null, null
from supplier left join G on m = concat('m', s_suppkey) where s_suppkey % 3 <> 0""")
def j9(spark, sf_dir):
    return market.replacement_grades(*_retirements(spark, sf_dir)).select(
        "model_id", cnt("option", "option"), "replacement", num("incumbent_grade", "incumbent_grade"),
        num("grade", "grade"), num("grade_delta", "grade_delta", 1))


@query("K4_radar", """
with S as (select concat('m', s_suppkey) as model_id, s_suppkey % 400 - 50 - 10 as days_left,
    s_suppkey % 13 = 0 as gone from supplier),
U as (select *, case when gone or days_left < 0 then 4 when days_left <= 30 then 0
    when days_left <= 90 then 1 when days_left <= 180 then 2 else 3 end as u from S)
select model_id, cast(days_left as bigint) as days_left, (['critical','soon','watch','clear','retired'])[u + 1] as urgency,
  u <= 1 as actionable, row_number() over (order by u, days_left, model_id) as ordinal from U""")
def k4(spark, sf_dir):
    retire, grades = _retirements(spark, sf_dir)
    return market.radar(retire, grades, F.lit("2026-01-11").cast("date")).select(
        "model_id", cnt("days_left", "days_left"), "urgency", "actionable", cnt("ordinal", "ordinal"))


# --------------------------------------------------------------------- cards
NOW = "2024-01-04 00:00:00"


def _cards(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    n = k * 7 % 900
    wins = F.expr("(c_custkey * 7 % 900) * (c_custkey % 10) div 10")
    cards = c.select(
        "c_custkey", F.col("c_name").alias("model_id"), proportion(wins, n).alias("quality"),
        F.when(k % 6 != 0, F.round(F.col("c_acctbal") / 100, 1)).alias("score"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=k % 100))
        .alias("updated_at"),
        F.when(k % 4 == 0, F.array(F.lit(50.0))).when(k % 4 == 1, F.sequence(F.lit(1), F.lit(30))
               .cast("array<double>")).otherwise(F.array().cast("array<double>")).alias("history"),
        F.when(k % 5 != 0, F.struct((k % 97 / F.lit(1000.0)).alias("cpat_usd"))).alias("_e"))
    econ = F.when(F.col("_e").isNotNull(), F.struct(
        F.col("_e.cpat_usd").alias("cpat_usd"), F.lit(1.0).alias("ttat_s"),
        F.lit(1).cast("long").alias("n_successes"), F.lit(1.0).alias("price_in"),
        F.lit(1.0).alias("price_out"), F.lit("list").alias("price_note")))
    return cards.withColumn("econ", econ).withColumn(
        "clusters", F.create_map(F.lit("code"), F.lit(0.5))).drop("_e")


CARDS_SQL = """
CD0 as (select c_custkey, c_name as model_id, c_custkey * 7 % 900 as n,
    (c_custkey * 7 % 900) * (c_custkey % 10) // 10 as s,
    case when c_custkey % 6 <> 0 then round(c_acctbal / 100, 1) end as score,
    timestamp '2024-01-01' + (c_custkey % 100) * interval '1 hour' as updated_at,
    case c_custkey % 4 when 0 then [50e0] when 1 then list_transform(range(1, 31), lambda x: cast(x as double))
      else [] end as history,
    case when c_custkey % 5 <> 0 then c_custkey % 97 / 1000e0 end as cpat from customer),
CD as (select *, case when n < 600 then 'provisional'
    when timestamp '2024-01-04' - updated_at > interval '48 hours' then 'stale' else 'confirmed' end
    as status from CD0)"""


@query("W10_classify_cards", f"""
with {CARDS_SQL},
H as (select *, case when score is null then history else list_concat(history, [score]) end as h0 from CD),
T as (select *, h0[greatest(len(h0) - 29, 1):] as h from H)
select model_id, status, round_even(({wilson_sql('s', 'n', 'high')} - {wilson_sql('s', 'n', 'low')}) * 100, 1)
    as ci_width_points, len(h) as n_history, h[-1] as last,
  case when score is not null and len(h) >= 2 then round_even(h[-1] - h[-2], 1) end as delta_points,
  status <> 'stale' and n >= 30 and score is not null as is_publishable,
  case when status = 'confirmed' then 'weekly' else 'daily' end as next_cadence from T""")
def w10(spark, sf_dir):
    out = market.classify_cards(_cards(spark, sf_dir), F.lit(NOW).cast("timestamp"), append=True)
    return out.select(
        "model_id", "status", "ci_width_points", cnt(F.size("history"), "n_history"),
        F.try_element_at("history", F.lit(-1)).alias("last"), "delta_points", "is_publishable",
        "next_cadence")


TICK_SQL = CARDS_SQL + """,
OL as (select * from CD where c_custkey % 4 <> 3),
CH as (select c_name as model_id from customer where c_custkey % 5 <> 4
        and (c_custkey % 10 = 0 or c_custkey % 9 = 1)),
DU as (select coalesce(OL.model_id, CH.model_id) as model_id, CH.model_id is not null as changed,
    updated_at from OL full join CH on OL.model_id = CH.model_id
    where CH.model_id is not null or status in ('provisional', 'stale')),
QU as (select *, row_number() over (order by changed desc,
    case when not changed then updated_at end nulls first, model_id) as pos from DU),
NG as (select c_name as model_id, c_custkey % 60 as n1, c_custkey % 60 * (c_custkey % 3) // 3 as s1,
    round(c_custkey % 100 * 0.9e0, 1) as score1 from customer where c_custkey % 8 <> 0),
AF as (select coalesce(OL.model_id, G.model_id) as model_id,
    G.model_id is null or (OL.n >= 30 and n1 < 30) is true as keep, OL.*, G.*
  from OL full join (select NG.* from NG join QU on NG.model_id = QU.model_id and pos <= 60) G
    on G.model_id = OL.model_id),
RS as (select model_id, case when keep then score else score1 end as score,
    case when keep then n else n1 end as n,
    case when keep then updated_at else timestamp '2024-01-04' end as updated_at,
    case when keep then len(history)
      else least(30, len(coalesce(history, [])) + 1) end as n_history from AF)"""


def _tick(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    catalog = c.filter(k % 5 != 4).select(
        F.lit("p").alias("provider"), F.col("c_name").alias("model_id"),
        F.when(k % 9 == 1, "v2").otherwise("v1").alias("version_hint"))
    known = c.filter(k % 10 != 0).select(F.col("c_name").alias("model_id"),
                                         F.lit("v1").alias("version_hint"))
    n = k % 60
    grades = c.filter(k % 8 != 0).select(
        F.col("c_name").alias("model_id"), F.round(k % 100 * F.lit(0.9), 1).alias("score"),
        proportion(F.expr("c_custkey % 60 * (c_custkey % 3) div 3"), n).alias("quality"),
        F.lit(None).cast(market.CARD_TYPES["econ"]).alias("econ"),
        F.lit(None).cast("map<string,double>").alias("clusters"))
    cards = _cards(spark, sf_dir).filter(k % 4 != 3)
    return market.grading_tick(cards, catalog, known, grades, F.lit(NOW).cast("timestamp"),
                               budget=3.0, est=0.05)


@query("W11_grading_tick", f"""
with {TICK_SQL}
select model_id, score, n, case when n < 600 then 'provisional'
    when timestamp '2024-01-04' - updated_at > interval '48 hours' then 'stale' else 'confirmed' end
    as status, cast(epoch_us(updated_at) as bigint) as updated_us, n_history from RS""")
def w11(spark, sf_dir):
    after, _, _ = _tick(spark, sf_dir)
    return after.select("model_id", "score", "n", "status",
                        F.unix_micros("updated_at").alias("updated_us"),
                        cnt(F.size("history"), "n_history"))


@query("W11_due_queue", f"""
with {TICK_SQL} select model_id, changed, pos as position, pos <= 60 as graded from QU""")
def w11_queue(spark, sf_dir):
    _, queue, _ = _tick(spark, sf_dir)
    return queue.select("model_id", "changed", cnt("position", "position"), "graded")


@query("A41_grade_counts", f"""
with {CARDS_SQL}
select count(*) filter (where status = 'provisional') as n_provisional,
  count(*) filter (where status = 'confirmed') as n_confirmed,
  count(*) filter (where status = 'stale') as n_stale from CD""")
def a41(spark, sf_dir):
    return market.grade_counts(
        market.classify_cards(_cards(spark, sf_dir), F.lit(NOW).cast("timestamp")))


@query("A37_composite_index", f"""
with {CARDS_SQL},
B as (select * from CD where score is not null and n >= 30 order by score desc, model_id limit 10),
C as (select list_sort(list(cpat) filter (where cpat is not null)) as v, count(*) as n,
        avg(score) as m, list(model_id order by score desc, model_id) as members from B)
select round_even(m, 2) as value, v[len(v) // 2 + 1] as median_cpat_usd, n,
  array_to_string(members, ',') as members from C""")
def a37(spark, sf_dir):
    cards = market.classify_cards(_cards(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return market.composite_index(cards).withColumn("members", F.array_join("members", ","))


def _market_body(spark, sf_dir):
    """A market catalog body per brand, as JSON text."""
    m, k = _models(spark, sf_dir), F.col("p_partkey")
    item = F.struct(
        F.concat(F.when(k % 17 == 5, "~").otherwise(""), "model_id",
                 F.when(k % 19 == 4, ":batch").otherwise("")).alias("id"),
        F.when(k % 2 == 0, F.col("p_name")).alias("name"),
        (F.lit(1704000000) - k * 7200).alias("created"),
        (k * 1000).alias("context_length"),
        F.struct(
            F.when(k % 7 == 6, "n/a").otherwise((k % 50 / F.lit(1e7)).cast("string")).alias("prompt"),
            (k % 40 / F.lit(1e6)).cast("string").alias("completion")).alias("pricing"),
        F.struct(F.when(k % 5 == 0, F.array(F.lit("text"), F.lit("image")))
                 .alias("input_modalities")).alias("architecture"))
    return m.groupBy("p_brand").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i"))))
                           .alias("x"))).alias("_j")
    ).select("p_brand", F.to_json(F.struct(F.expr(
        "transform(from_json(_j, 'struct<x:array<struct<p_partkey:bigint,i:struct<id:string,name:string,"
        "created:bigint,context_length:bigint,pricing:struct<prompt:string,completion:string>,"
        "architecture:struct<input_modalities:array<string>>>>>>').x, e -> e.i)").alias("data"))).alias("body"))


MARKET_NOW = "2024-01-01 00:00:00"

MARKET_SQL = MODELS_SQL + """,
MK as (select model_id as id, p_partkey as k, case when p_partkey % 2 = 0 then p_name else model_id end as name,
    case when p_partkey % 7 = 6 then 0e0 else round(p_partkey % 50 / 1e7 * 1e6, 4) end as price_in,
    case when p_partkey % 7 = 6 then 0e0 else round(p_partkey % 40 / 1e6 * 1e6, 4) end as price_out,
    p_partkey * 1000 as context, (1704067200 - (1704000000 - p_partkey * 7200)) // 86400 as age_days,
    case when p_partkey % 5 = 0 then 'text+image' else 'text' end as modalities
  from MO where p_partkey % 17 <> 5 and p_partkey % 19 <> 4),
MF as (select *, id like '%:free' or (price_in = 0 and price_out = 0) as free from MK)"""


def _market(spark, sf_dir):
    """The parsed market with the part key as feed order."""
    body = _market_body(spark, sf_dir)
    rows = market.parse_market(body, F.lit(MARKET_NOW).cast("timestamp"))
    bare = F.regexp_replace("id", ":free$", "")
    return rows.withColumn("position", F.regexp_extract(bare, "([0-9]+)$", 1).cast("long"))


@query("S15_parse_market", f"""
with {MARKET_SQL}
select id, name, split_part(id, '/', 1) as vendor, price_in, price_out, context, age_days, free,
  modalities from MF""")
def s15(spark, sf_dir):
    return _market(spark, sf_dir).select(
        "id", "name", "vendor", "price_in", "price_out", "context", cnt("age_days", "age_days"),
        "free", "modalities")


@query("S14_parse_catalog", f"""
with {MODELS_SQL}
select provider, model_id, case when p_partkey % 3 = 0 then cast(p_partkey + 1 as varchar)
    when p_partkey % 3 = 1 then '2024' else 'unknown' end as version_hint from MO where p_partkey % 10 <> 9""")
def s14(spark, sf_dir):
    m, k = _models(spark, sf_dir), F.col("p_partkey")
    entry = F.struct(
        F.concat(F.when(k % 2 == 0, "models/").otherwise(" "),
                 F.when(k % 10 != 9, F.col("model_id")).otherwise("")).alias("id"),
        F.when(k % 3 == 0, k + 1).otherwise(F.lit(0)).alias("created"),
        F.when(k % 3 == 1, "2024").alias("updated_at"))
    bodies = m.groupBy("provider", "p_brand").agg(F.collect_list(entry).alias("data"))
    body = F.when(F.col("provider") == "groq", F.to_json("data")).otherwise(
        F.to_json(F.struct("data")))
    return market.parse_catalog(bodies.select("provider", body.alias("body"))).drop("position")


@query("S17_feed_rows", f"""
with {MARKET_SQL}, {CARDS_SQL},
R as (select *, row_number() over (order by score desc, model_id) as rank from CD
      where score is not null and n >= 30),
Y as (select *, row_number() over (order by age_days, k, id) as rank from MF
      where age_days between 1 and 7)
select 'badge' as kind, rank, model_id, score, null::double as delta, cpat as cpat_usd from R
union all select 'move', rank, model_id, score, case when len(history) >= 2 then history[-1] - history[-2]
  else 0e0 end, cpat from R where rank <= 15
union all select 'new', rank, id, null, null, null from Y where rank <= 15""")
def s17(spark, sf_dir):
    cards = market.classify_cards(_cards(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return market.feed_rows(cards, _market(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("K5_picker_rows", f"""
with {MARKET_SQL},
H as (select *, case when free then null when starts_with(id, 'anthropic/claude') then 0
    when starts_with(id, 'openai/gpt') then 1 when starts_with(id, 'google/gemini') then 2
    when starts_with(id, 'x-ai/grok') then 3 when starts_with(id, 'deepseek/') then 4 end as h from MF),
F as (select *, h is not null and row_number() over (partition by h order by k) = 1 as flag from H),
G as (select *, case when age_days <= 21 then 0 when free then 1 when flag then 2 end as g from F)
select row_number() over (order by g, k, id) as rank, id, name from G where g is not null
order by 1 limit 40""")
def k5(spark, sf_dir):
    return market.picker_rows(_market(spark, sf_dir)).select(cnt("rank", "rank"), "id", "name")


NON_CHAT_SQL = market.NON_CHAT.replace("(?i)", "")


@query("P25_gradable", f"""
with {MODELS_SQL}
select provider, model_id from MO where not regexp_matches(model_id, '{NON_CHAT_SQL}', 'i')
  and (provider <> 'openrouter' or model_id like '%:free')""")
def p25(spark, sf_dir):
    return market.gradable(_models(spark, sf_dir)).select("provider", "model_id")


@query("P26_rotate", f"""
with {MODELS_SQL},
R as (select provider, model_id, row_number() over (partition by provider order by
    case when p_partkey % 6 <> 0 or p_partkey % 12 = 0 then 0 else 1 end, p_partkey, model_id) as r from MO)
select provider, model_id from R where r <= case provider when 'openrouter' then 30 when 'google' then 40
  else 100000000 end""")
def p26(spark, sf_dir):
    m, k = _models(spark, sf_dir), F.col("p_partkey")
    cards = m.filter(k % 6 == 0).select("model_id", F.when(k % 12 == 0, 0).otherwise(5).alias("n"))
    return market.rotate(m.select("provider", "model_id", "position"), cards,
                         {"openrouter": 30, "google": 40}).select("provider", "model_id")


def _graded_models(spark, sf_dir):
    m, k = _models(spark, sf_dir), F.col("p_partkey")
    return m.select(
        "model_id", (k % 45).alias("n"), F.col("p_retailprice").alias("_p"),
        (k % 80 + F.lit(20.25)).alias("score"),
        F.struct((k % 9 / F.lit(100.0)).alias("cpat_usd")).alias("econ"))


PROVIDER_SQL = f"""case when {' or '.join(f"contains(lower(model_id), '{w}')" for w in rules.SERVED_ANYWHERE)}
  then 'groq' {' '.join("when " + " or ".join(f"starts_with(lower(model_id), '{w}')" for w in ws) + f" then '{p}'"
  for ws, p in rules.SERVED_PREFIXES)} when contains(model_id, '/') then 'openrouter' else 'groq' end"""


@query("K1_auto_pick", f"""
with {MODELS_SQL},
C as (select model_id, p_partkey % 80 + 20.25e0 as score, p_partkey % 9 / 100e0 as cpat, {PROVIDER_SQL} as pr
      from MO where p_partkey % 45 >= 30)
select model_id, score, cpat as cpat_usd, row_number() over (order by round_even(score, 0) desc, cpat, model_id)
  as rank from C where score >= 60 and pr in ('groq', 'openai')""")
def k1(spark, sf_dir):
    return market.auto_pick(_graded_models(spark, sf_dir), ["groq", "openai"]).withColumn(
        "rank", F.col("rank").cast("long"))


@query("K2_route", f"""
with {MODELS_SQL}, C as (select model_id, {PROVIDER_SQL} as provider, p_partkey % 80 + 20.25e0 as grade from MO),
G as (select *, provider in ('groq','openrouter','ollama','google','github','cerebras') as free from C where grade >= 50)
select model_id, provider, grade, free from G order by free desc, grade desc, model_id limit 1""")
def k2(spark, sf_dir):
    c = market.candidates_from(_graded_models(spark, sf_dir))
    return market.route(c, min_grade=50)


@query("A35_pool_quality", f"""
with {ad.LINEITEM_TASKS_SQL},
M as (select finisher as model_id, count(*) filter (where known) as n,
    count(*) filter (where known and succeeded) as s from LT group by all)
select model_id, n, round(s / cast(n as double), 6) as rate, round({wilson_sql('s', 'n', 'low')}, 6) as ci_low,
  round_even(s / cast(n as double) * 100, 1) as score from M""")
def a35(spark, sf_dir):
    m, _ = _cluster_metrics(spark, sf_dir)
    return market.pool_quality(m).select(
        "model_id", F.col("quality.n").alias("n"), num("quality.value", "rate"),
        num("quality.ci_low", "ci_low"), "score")


@query("A35_pool_economics", f"""
with {ad.LINEITEM_TASKS_SQL}, {CLUSTER_METRICS_SQL}
select model_id, cast(sum(wins) as bigint) as n_successes, round(sum(cpat * wins) / sum(wins), 4) as cpat_usd,
  round(sum(ttat * wins) / sum(wins), 1) as ttat_s from CM group by model_id having sum(wins) > 0""")
def a35_econ(spark, sf_dir):
    m, _ = _cluster_metrics(spark, sf_dir)
    e = market.pool_economics(m)
    return e.select("model_id", "n_successes", num("cpat_usd", "cpat_usd", 4), num("ttat_s", "ttat_s", 1))


@query("A36_bench_metrics", f"""
with {ad.PRICES_SQL},
B as (select concat('c', l_linenumber % 3) as cluster_id, concat('model-', l_suppkey % 4) as model_id,
    case when l_linenumber % 2 = 0 then l_returnflag = 'A' else l_linestatus = 'F' end as succeeded,
    true as known, 1 as attempts, greatest(1, cast(l_quantity as bigint)) as wall,
    (l_partkey % 900 * p_in + l_partkey % 300 * p_out) / 1000000 as cost
  from lineitem join P on P.model_id = concat('model-', l_suppkey % 4)),
M as (select cluster_id, model_id, {CORE_SQL} from B group by all)
select cluster_id, model_id, n_tasks, wins, round(wins / cast(n_verified as double), 6) as success_rate,
  round(cost_sum / nullif(wins, 0), 9) as cpat, round(wall_sum / nullif(wins, 0), 6) as ttat from M""")
def a36(spark, sf_dir):
    d = ad.table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    outputs = d.select(
        line.cast("string").alias("task_id"),
        F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("output"),
        F.concat(F.lit("model-"), (F.col("l_suppkey") % 4).cast("string")).alias("model_id"),
        (F.col("l_partkey") % 900).alias("input_tokens"),
        (F.col("l_partkey") % 300).alias("output_tokens"),
        F.col("l_quantity").cast("long").alias("wall_ms"))
    tasks = d.select(line.cast("string").alias("task_id"), line.alias("ln")).distinct().select(
        "task_id", F.concat(F.lit("c"), (F.col("ln") % 3).cast("string")).alias("cluster"),
        F.lit("regex").alias("check"),
        F.when(F.col("ln") % 2 == 0, "^A/").otherwise("/F$").alias("contract_regex"),
        none.alias("expected"), none.alias("answer"), none.alias("source"), none.alias("json_schema"),
        F.array().cast("array<string>").alias("must_include"),
        F.array().cast("array<string>").alias("forbidden"))
    return market.bench_metrics(outputs, tasks, ad.prices_from_nation(spark, sf_dir)).select(
        "cluster_id", "model_id", "n_tasks", F.col("cpat_usd.n_successes").alias("wins"),
        num("success_rate.value", "success_rate"), num("cpat_usd.value", "cpat", 9),
        num("ttat_seconds.value", "ttat"))


@query("W16_rank_rows", f"""
with {ad.LINEITEM_TASKS_SQL}, M as (select finisher as model_id, {CORE_SQL} from LT group by finisher),
R as (select model_id, row_number() over (order by wins / cast(n_verified as double) desc, model_id) as rank from M)
select model_id, rank, (['gold','silver','bronze'])[rank] as medal from R""")
def w16(spark, sf_dir):
    t, _ = lineitem_tasks(spark, sf_dir)
    m = metrics.core_metrics_by_model(t)
    return metrics.rank_rows(m, [F.col("success_rate.value").desc(), F.col("model_id")]).select(
        "model_id", cnt("rank", "rank"), "medal")
