"""Juries over labelled documents: quality and toxicity labels and a length rule are the judges."""

from pyspark.sql import functions as F

from winledger.operators import jury
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query


def _verdicts(spark, sf_dir):
    """Three judges per labelled document; the third judged in both orders, and not at all the
    German documents of one source."""
    d = ad.table(spark, sf_dir, "documents").join(ad.table(spark, sf_dir, "labels"), "doc_id")

    def judge(name, position, score, prob):
        return F.struct(F.lit(name).alias("judge_id"), F.lit(f"lab-{name}").alias("judge_lab"),
                        F.lit(position).alias("position"), score.alias("score"), prob.alias("prob"))

    x, n = F.col("n_chars"), F.col("doc_id")
    all_of = F.array(
        judge("a", "", F.col("quality").cast("double"), F.lit(0.9)),
        judge("b", "", 1.0 - F.col("toxic").cast("double"), F.lit(0.8)),
        judge("c", "ab", x % 11 / F.lit(10.0), F.lit(0.7)),
        judge("c", "ba", n % 11 / F.lit(10.0), F.lit(0.6)))
    rows = d.select("doc_id", "lang", "source", F.explode(all_of).alias("v")).filter(
        ~((F.col("lang") == "de") & (F.col("source") == "src0") & (F.col("v.judge_id") == "c")))
    return rows.select(
        F.col("doc_id").alias("item_id"), "lang", "v.judge_id", "v.judge_lab", "v.position", "v.score",
        F.col("v.prob").alias("calibrated_prob"),
        F.array().cast("array<struct<start:bigint,end:bigint,reason:string>>").alias("flagged_spans"),
        F.lit("0.25").cast("decimal(9,4)").alias("cost_usd"),
        F.concat(F.lit("because "), "v.judge_id", "v.position").alias("reason"))


VERDICTS_SQL = """
VD as (select doc_id as item_id, lang, unnest([
      {'j': 'a', 'pos': '', 's': cast(quality as double), 'p': 0.9e0},
      {'j': 'b', 'pos': '', 's': 1 - cast(toxic as double), 'p': 0.8e0},
      {'j': 'c', 'pos': 'ab', 's': n_chars % 11 / 10e0, 'p': 0.7e0},
      {'j': 'c', 'pos': 'ba', 's': doc_id % 11 / 10e0, 'p': 0.6e0}]) as v, source
  from documents join labels using (doc_id)),
VV as (select item_id, lang, v.j as j, v.pos as pos, v.s as s, v.p as p from VD
       where not (lang = 'de' and source = 'src0' and v.j = 'c')),
JS as (select item_id, lang, j, avg(s) as s from VV group by all),
JC as (select item_id, lang, count(*) as n, avg(s) as mean,
    count(*) filter (where s < 0.4) as c0, count(*) filter (where s >= 0.4 and s < 0.7) as c1,
    count(*) filter (where s >= 0.7) as c2 from JS group by all),
KA as (select lang, count(*) as n_items, min(n) as lo, max(n) as hi,
    avg((c0*c0 + c1*c1 + c2*c2 - n) / cast(n * (n - 1) as double)) as pbar,
    power(sum(c0) / cast(sum(n) as double), 2) + power(sum(c1) / cast(sum(n) as double), 2)
      + power(sum(c2) / cast(sum(n) as double), 2) as pe from JC where n >= 2 group by lang),
KP as (select lang, n_items, case when n_items >= 2 and lo = hi then
    case when pe >= 1 then 1e0 else (pbar - pe) / (1 - pe) end end as kappa from KA)"""


@query("A31_fleiss_kappa", f"with {VERDICTS_SQL} select lang, n_items, round(kappa, 6) as kappa from KP")
def a31(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return jury.fleiss_kappa(v, batch=["lang"]).select("lang", "n_items", num("kappa", "kappa"))


PANEL_SQL = VERDICTS_SQL + """,
RQ as (select doc_id as item_id, lang from documents where doc_id % 2 = 0 or doc_id % 5 = 0),
PX as (select item_id, avg(p) as prob, count(*) * 0.25 as cost from VV group by item_id),
PA as (select RQ.item_id, coalesce(n, 0) as n, coalesce(mean, 0.5e0) as mean, coalesce(prob, 0e0) as prob,
    coalesce(greatest(c0, c1, c2) / cast(n as double), 0e0) as agr, kappa, coalesce(cost, 0) as cost
  from RQ left join JC on JC.item_id = RQ.item_id left join PX on PX.item_id = RQ.item_id
    left join KP on KP.lang = RQ.lang),
PL as (select *, n < 2 or coalesce(kappa < 0.4, false) and item_id % 4 <> 0 or agr < 0.6 as low0 from PA),
PZ as (select *, n < 2 or agr < 0.6 as low from PA)"""


def _panel(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    d = ad.table(spark, sf_dir, "documents")
    rq = d.filter("doc_id % 2 = 0 or doc_id % 5 = 0").select(
        F.col("doc_id").alias("item_id"), "lang", F.lit("judge").alias("action"),
        jury.dimension_for(F.col("text"), F.lit(False)).alias("dimension"),
        F.col("text").alias("prompt"), F.col("source").alias("answer"))
    return v, rq


@query("A32_combine_panel", f"""
with {PANEL_SQL}
select item_id, round(round_even(mean, 4), 4) as score, round_even(prob, 4) as calibrated_prob,
  round_even(agr, 4) as agreement, low as low_agreement, n as n_judges,
  case when low then 'unknown' when mean >= 0.7 then 'pass' else 'fail' end as status,
  case when low then 0e0 else round_even(least(1e0, prob * agr * least(1e0, n / 3e0)), 4) end as confidence,
  case when not low and n >= 3 then 'derived' else 'declared' end as grade, cast(cost as double) as cost_usd
from PZ""")
def a32(spark, sf_dir):
    v, rq = _panel(spark, sf_dir)
    return jury.combine_panel(v, rq, min_jurors=2).select(
        "item_id", "score", "calibrated_prob", "agreement", "low_agreement", cnt("n_judges", "n_judges"),
        F.col("verification.status").alias("status"),
        F.col("verification.confidence").alias("confidence"),
        F.col("verification.evidence_grade").alias("grade"),
        F.col("cost_usd").cast("double").alias("cost_usd"))


@query("A32_combine_panel_kappa", f"""
with {PANEL_SQL}
select item_id, round(kappa, 6) as kappa,
  n < 3 or coalesce(kappa < 0.4, false) or agr < 0.6 as low_agreement from PA""")
def a32_kappa(spark, sf_dir):
    v, rq = _panel(spark, sf_dir)
    k = jury.fleiss_kappa(v, batch=["lang"])
    return jury.combine_panel(v, rq, k, batch=["lang"]).select(
        "item_id", num("kappa", "kappa"), "low_agreement")


@query("A33_training_rows", f"""
with {PANEL_SQL},
R as (select item_id, list(concat('because ', j, pos) order by j, pos) as reasons from VV group by item_id)
select item_id, round_even(mean, 4) as score, array_to_string(reasons, '|') as reasons
from PZ join R using (item_id) where not low and round_even(agr, 4) >= 0.9""")
def a33(spark, sf_dir):
    v, rq = _panel(spark, sf_dir)
    items = jury.combine_panel(v, rq, min_jurors=2)
    return jury.training_rows(items, v, min_agreement=0.9).select(
        "item_id", "score", F.array_join("reasons", "|").alias("reasons"))


@query("A33_export_verdicts", f"""
with {PANEL_SQL}
select item_id, sha256(concat('salt', text))[1:32] as prompt_hash, sha256(concat('salt', source))[1:32] as answer_hash,
  low as low_agreement, (select count(*) from VV where VV.item_id = PZ.item_id) as n_verdicts
from PZ join documents on doc_id = item_id""")
def a33_export(spark, sf_dir):
    v, rq = _panel(spark, sf_dir)
    items = jury.combine_panel(v, rq, min_jurors=2)
    return jury.export_verdicts(items, v, "salt").select(
        "item_id", "prompt_hash", "answer_hash", "low_agreement",
        cnt(F.coalesce(F.size("judges"), F.lit(0)), "n_verdicts"))


@query("A34_cross_check", f"""
with {PANEL_SQL},
C as (select item_id, item_id // 10 as q, case when n > 0 then round_even(mean, 4) end as score, low from PZ),
R as (select *, row_number() over (partition by q order by coalesce(score, 0e0) desc, item_id) as rank from C)
select item_id, q as question_id, rank, coalesce(rank = min(case when score is not null and not low
  then rank end) over (partition by q), false) as winner from R""")
def a34(spark, sf_dir):
    v, rq = _panel(spark, sf_dir)
    items = jury.combine_panel(v, rq, min_jurors=2)
    results = items.select(
        "item_id", F.expr("item_id div 10").alias("question_id"), F.col("item_id").alias("model_id"),
        F.when(F.col("n_judges") > 0, F.col("score")).alias("score"), "low_agreement")
    return jury.cross_check(results).select("item_id", "question_id", cnt("rank", "rank"), "winner")


@query("P21_parse_verdicts", """
select doc_id as item_id,
  case doc_id % 5 when 0 then 1e0 when 1 then 0.5e0 when 2 then 0.5e0 when 3 then 0.75e0 else 0.4e0 end as score,
  case doc_id % 5 when 0 then 0.5e0 when 3 then 0.9e0 else 0e0 end as calibrated_prob,
  case doc_id % 5 when 0 then n_chars end as span_end,
  case doc_id % 5 when 0 then 'a b' when 1 then 'unparseable verdict' when 4 then 'x' else 'no reason given' end
    as reason from documents""")
def p21(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 5
    reply = F.concat(F.lit("I think {so}: "), F.when(
        m == 0, '{"score": 1.7, "prob": "0.5", "spans": [{"start": 2, "end": 99999999, "reason": "r"}, 7, '
                '{"start": null}], "reason": " a \\n b "} {"score": 0}')
        .when(m == 1, "garbage {").when(m == 2, '{"score": null, "prob": [1]}')
        .when(m == 3, '{"score": 0.25, "prob": 0.9, "spans": [{"start": 0, "end": 1}]}')
        .otherwise('{"x": {"y": 1}, "score": 0.4, "reason": "x"} trailing'))
    rows = d.select(
        F.col("doc_id").alias("item_id"), F.lit("j").alias("judge_id"), F.lit("l").alias("judge_lab"),
        F.when(m == 3, "ba").otherwise("").alias("position"), reply.alias("reply"),
        F.col("n_chars").alias("answer_chars"))
    return jury.parse_verdicts(rows).select(
        "item_id", "score", "calibrated_prob",
        F.get("flagged_spans", F.lit(0))["end"].alias("span_end"), "reason")


@query("P22_dimension_for", """
select doc_id, case when doc_id % 4 = 0 then 'faithfulness' when contains(text, '```') or contains(text, 'def ')
  or contains(text, 'function ') then 'code_correctness' else 'instruction_following' end as dimension
from documents""")
def p22(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    return d.select("doc_id", jury.dimension_for(F.col("text"), F.col("doc_id") % 4 == 0).alias("dimension"))


def _seats_sql():
    from winledger.functions import rules
    from winledger.queries.market import MODELS_SQL, _values

    return f"""
with {MODELS_SQL},
RU as (select *, row_number() over () as o from (values {_values(rules.LABS)}) t(hint, lab)),
B as (select p_partkey, model_id, lower(model_id) as low,
        case when contains(model_id, '/') then lower(split_part(model_id, '/', 2)) end as rest from MO),
R as (select model_id, arg_min(lab, o) as lab from B join RU on starts_with(low, hint)
        or starts_with(rest, hint) group by model_id),
LB as (select B.*, coalesce(lab, case when rest is not null then split_part(low, '/', 1) else 'unknown' end) as lab
       from B left join R using (model_id)),
FC as (select lab, min(p_partkey) as o, arg_min(model_id, p_partkey) as m from LB
       where p_partkey % 2 = 1 and lab <> 'unknown' group by lab),
LS as (select distinct lab from LB),
PN as (select LS.lab, list(m order by o)[1:3] as js from LS, FC where FC.lab <> LS.lab group by LS.lab)
select p_partkey, LB.lab, array_to_string(js, ',') as jurors, len(js) < 3 as thin_panel
from LB join PN using (lab)"""


@query("J10_seat_jury", _seats_sql())
def j10(spark, sf_dir):
    from winledger.queries.market import _models

    m = _models(spark, sf_dir)
    answers = m.select("p_partkey", "model_id")
    candidates = m.filter("p_partkey % 2 = 1").select("model_id", F.col("p_partkey").alias("ordinal"))
    return jury.seat_jury(answers, candidates).select(
        "p_partkey", "lab", F.array_join("jurors", ",").alias("jurors"), "thin_panel")
