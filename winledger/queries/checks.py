"""Verifiers and benchmark checks."""

from pyspark.sql import functions as F

from winledger.operators import checks, tasks, verify
from winledger.plans import adapters as ad
from winledger.queries import num, query


def _verdict(col):
    return [F.col(f"{col}.status").alias("status"), F.col(f"{col}.signal").alias("signal"),
            F.col(f"{col}.evidence_grade").alias("grade")]


LINE_ID = "concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey)"


def _lines(spark, sf_dir):
    d = ad.table(spark, sf_dir, "lineitem")
    return d.withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("P3_verify_exit_code", f"""
select {LINE_ID} as id, case when l_linenumber % 5 = 4 then null when l_linenumber % 5 = 0 then 'pass'
  else 'fail' end as status,
  case when l_linenumber % 5 <> 4 then 'test_exit_code' end as signal,
  case when l_linenumber % 5 <> 4 then 'measured' end as grade from lineitem""")
def p3(spark, sf_dir):
    m = F.col("l_linenumber") % 5
    code = F.when(m != 4, m)
    return _lines(spark, sf_dir).withColumn("v", verify.verify_exit_code(code)).select(
        "id", *_verdict("v"))


@query("P4_verify_json_schema", """
select event_id, case when cast(json_extract(props, '$.k') as bigint)
    between 10 and length(event_type) * 10 then 'pass' else 'fail' end as status from events""")
def p4(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    schema = F.format_string(
        '{"type":"object","required":["k"],"additionalProperties":false,'
        '"properties":{"k":{"type":"integer","minimum":10,"maximum":%d}}}',
        F.length("event_type") * 10)
    v = verify.verify_json_schema(F.col("props"), schema)
    return e.select("event_id", v["status"].alias("status"))


@query("P5_verify_regex", r"""
select doc_id, case when regexp_matches(text, case lang when 'en' then 'th[aeiou]r\w' when 'fr'
    then 'eau(x|l)' when 'de' then '[0-9]{3}' else '(ing|ion)[.]' end) then 'pass' else 'fail' end
  as status from documents""")
def p5(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    pattern = (
        F.when(F.col("lang") == "en", r"th[aeiou]r\w").when(F.col("lang") == "fr", "eau(x|l)")
        .when(F.col("lang") == "de", "[0-9]{3}").otherwise("(ing|ion)[.]"))
    return d.select("doc_id", verify.verify_regex(F.col("text"), pattern)["status"].alias("status"))


@query("P6_verify_acceptance", f"""
with {ad.EVENTS_SQL},
N as (select trace_id, event_type, coalesce(lead(template) over w = template
    and lead(epoch_us(ts_start)) over w - epoch_us(ts_end) <= 600000000, false) as retried
  from E window w as (partition by session_id order by ts_start, trace_id))
select trace_id, case when event_type = 'purchase' then 'pass'
    when retried or event_type = 'error' then 'fail' else 'pass' end as status,
  case when event_type = 'purchase' then 1e0 else 0.7e0 end as confidence from N""")
def p6(spark, sf_dir):
    linked = tasks.link_attempts(ad.attempts_from_events(spark, sf_dir))
    kind = F.col("verification.signal")
    v = verify.verify_acceptance(
        F.when(kind == "purchase", True), F.col("retried_within_10m"), kind == "error")
    return linked.select("trace_id", v["status"].alias("status"),
                         v["confidence"].alias("confidence"))


@query("P7_verify_equivalence_json", """
select event_id, case event_id % 5 when 0 then 'pass' when 4 then
    case when user_id % 2 = 0 then 'pass' else 'fail' end else 'fail' end as status,
  case event_id % 5 when 2 then 'equiv_json_unparseable' when 4 then 'equiv_test_pass'
    else 'equiv_json_fields' end as signal from events""")
def p7_json(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    k, m = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 5
    cand = (
        F.when(m == 0, F.format_string('{"x": [1], "k": %d.0}', k))
        .when(m == 1, F.format_string('{"k": %d}', k + 1)).when(m == 2, "no json")
        .when(m == 3, '{"j": 1}').otherwise(F.col("props")))
    code = F.when(m == 4, (F.col("user_id") % 2).cast("int"))
    v = verify.verify_equivalence(F.col("props"), cand, code)
    return e.select("event_id", v["status"].alias("status"), v["signal"].alias("signal"))


@query("P7_verify_equivalence_text", r"""
with N as (select doc_id, len(regexp_extract_all(text, '-?[0-9]+')) > 0 as has from documents)
select doc_id, case when doc_id % 3 = 0 then 'pass' else 'fail' end as status,
  case when doc_id % 3 = 1 and has then 'equiv_number_mismatch' else 'equiv_text_exact' end as signal
from N""")
def p7_text(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    m, text = F.col("doc_id") % 3, F.col("text")
    cand = (
        F.when(m == 0, F.concat(F.lit("\n"), F.replace(text, F.lit(" "), F.lit(" \t"))))
        .when(m == 1, F.concat(text, F.lit(" 7"))).otherwise(F.concat(F.lit("x "), text)))
    v = verify.verify_equivalence(text, cand, F.lit(None).cast("int"))
    return d.select("doc_id", v["status"].alias("status"), v["signal"].alias("signal"))


@query("P8_resolve_verdicts", f"""
with A as (select {LINE_ID} as id,
    case when l_linenumber % 3 = 0 then case when l_partkey % 2 = 0 then 'pass' else 'fail' end end
      as ex,
    case when l_linenumber % 2 = 0 then case when l_returnflag = 'A' then 'pass' else 'fail' end end
      as rx,
    case when l_linenumber % 5 = 0 then case when l_quantity > 25 then 'pass' else 'fail' end end
      as ac from lineitem)
select id,
  case when ex = 'fail' then 'fail' when rx = 'fail' then 'fail' when ex is not null then ex
    when rx is not null then rx when ac is not null then ac else 'unknown' end as status,
  case when ex = 'fail' then 'test_exit_code' when rx = 'fail' then 'regex_contract'
    when ex is not null then 'test_exit_code' when rx is not null then 'regex_contract'
    when ac is not null then 'silent_acceptance' else 'none' end as signal,
  case when ex is not null or rx is not null then 'measured' when ac is not null then 'derived'
    else 'declared' end as grade
from A""")
def p8(spark, sf_dir):
    n = F.col("l_linenumber")
    d = _lines(spark, sf_dir).select(
        "id", F.when(n % 3 == 0, (F.col("l_partkey") % 2).cast("int")).alias("exit_code"),
        F.col("l_returnflag").alias("output_text"),
        F.when(n % 2 == 0, "^A").alias("contract_regex"),
        F.when(n % 5 == 0, F.col("l_quantity") > 25).alias("accepted_downstream"),
        F.when(n % 5 == 0, True).alias("retried_within_10m"))
    return verify.default_verifiers().verify(verify.with_artifacts(d)).select(
        "id", *_verdict("verification"))


@query("U1_register_verifier", f"""
select {LINE_ID} as id, case when l_quantity > 40 then 'fail' when l_discount > 0.05 then 'pass'
    else 'unknown' end as status,
  case when l_quantity > 40 then 'bulk' when l_discount > 0.05 then 'rebate' else 'none' end as signal,
  case when l_quantity > 40 then 'measured' when l_discount > 0.05 then 'derived' else 'declared' end
    as grade from lineitem""")
def u1(spark, sf_dir):
    bulk, rebate = F.col("l_quantity") > 40, F.col("l_discount") > 0.05
    own = (
        verify.VerifierSet()
        .register_verifier("rebate", "derived", rebate,
                           verify.verdict(rebate, "rebate", grade="derived"))
        .register_verifier("bulk", "measured", bulk, verify.verdict(~bulk, "bulk")))
    return own.verify(_lines(spark, sf_dir)).select("id", *_verdict("verification"))


@query("P9_check_json_values", """
with K as (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)
select event_id, event_id % 4 <> 3
  and abs(k - (k + event_id % 3 - 1)) <= 0.01e0 * greatest(1, abs(k + event_id % 3 - 1)) as passed from K""")
def p9(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    shown = F.when(F.col("event_id") % 4 == 3, F.lit("none {x}")).otherwise(
        F.format_string('Sure {not json} {"a": {"list": [0, "%s,"]}, "kind": "%s."}',
                        k, F.upper("event_type")))
    want = F.format_string('{"a.list.1": %d, "kind": "\'%s\'"}', k + F.col("event_id") % 3 - 1,
                           F.col("event_type"))
    return e.select("event_id", checks.check_json_values(shown, want).alias("passed"))


@query("P10_check_exact", f"""
select {LINE_ID} as id,
  abs(l_quantity - (l_quantity + l_linenumber % 2 / 2e0))
    <= 0.01e0 * greatest(1, l_quantity + l_linenumber % 2 / 2e0) as by_number,
  l_returnflag = 'A' as by_text from lineitem""")
def p10(spark, sf_dir):
    d = _lines(spark, sf_dir)
    q = F.col("l_quantity")
    said = F.concat(F.lit("one 3\nAnswer : 1\n answer: **"), q.cast("string"), F.lit(" units** \n"))
    want = (q + F.col("l_linenumber") % 2 / F.lit(2.0)).cast("string")
    text = F.concat(F.lit("so\r\nit is '"), "l_returnflag", F.lit("'."))
    return d.select("id", checks.check_exact(said, want).alias("by_number"),
                    checks.check_exact(text, F.lit('"A."')).alias("by_text"))


@query("P11_check_faithful", """
select doc_id, contains(text, 'e ') and (doc_id % 2 = 0 or contains(text, '987654321')) as passed
from documents""")
def p11(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    out = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(
        F.concat("text", F.lit(" +987,654,321%")))
    return d.select("doc_id", checks.check_faithful(
        out, F.array(F.lit("e ")), F.col("text")).alias("passed"))


_REFUSAL_SQL = checks.REFUSAL.replace("(?iU)", "(?i)").replace("'", "''")


@query("P12_check_refusal_secret", f"""
with O as (select doc_id, case doc_id % 3 when 0 then concat('I cannot do that. ', text)
    when 1 then text else ' ' end as o from documents)
select doc_id, not contains(lower(o), 'token') and (regexp_matches(o, '{_REFUSAL_SQL}') or trim(o) = '')
  as refusal, not contains(lower(o), 'token') as secret from O""")
def p12(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 3
    o = F.when(m == 0, F.concat(F.lit("I cannot do that. "), "text")).when(
        m == 1, F.col("text")).otherwise(F.lit(" "))
    bad = F.array(F.lit("TOKEN"))
    return d.select("doc_id", checks.check_refusal(o, bad).alias("refusal"),
                    checks.check_secret(o, bad).alias("secret"))


@query("P13_same_result", """
select count(*) = 0 as same, count(*) as n_different from orders where o_orderkey % 100 = 0""")
def p13(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c"))
    b = o.filter(F.col("o_orderkey") % 100 != 0).select(
        F.format_number("o_orderkey", 0).alias("k"),
        F.concat(F.lit(" '"), F.lower("o_orderstatus"), F.lit(".' ")).alias("s"),
        F.col("o_custkey").alias("c"))
    return checks.same_result(a, b)


@query("P14_grade_outputs", """
select event_id, case event_type when 'purchase' then
      abs(cast(json_extract(props, '$.k') as bigint) - 50) <= 0.5e0
    when 'signup' then regexp_matches(props, '7') when 'click' then
      cast(json_extract(props, '$.k') as bigint) <= 60
    when 'view' then not contains(props, '9') else user_id % 2 = 0 end as passed from events""")
def p14(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    t = e.select(F.col("event_type").alias("task_id")).distinct()
    kind = F.col("task_id")
    none = F.lit(None).cast("string")
    plan = t.select(
        "task_id",
        F.when(kind == "purchase", "json_values").when(kind == "signup", "regex")
        .when(kind == "click", "schema").when(kind == "view", "secret").otherwise("code_tests")
        .alias("check"),
        F.lit('{"k": 50}').alias("expected"), none.alias("answer"), none.alias("source"),
        F.array().cast("array<string>").alias("must_include"),
        F.array(F.lit("9")).alias("forbidden"), F.lit("7").alias("contract_regex"),
        F.lit('{"properties": {"k": {"type": "integer", "maximum": 60}}}').alias("json_schema"))
    out = e.select("event_id", F.col("event_type").alias("task_id"),
                   F.col("props").alias("output"), (F.col("user_id") % 2).alias("exit_code"))
    return checks.grade_outputs(out, plan).select("event_id", "passed")


@query("U2_resolve_outputs", r"""
with T as (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents)
select a.doc_id, b.t is not null as resolved, coalesce(a.t = b.t, false) as passed
from T a left join T b on b.doc_id = a.doc_id + case when a.doc_id % 2 = 0 then 0 else 1 end""")
def u2(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")

    def ref(n):
        return F.concat(F.lit("trace://"), n.cast("string"), F.lit("/output"))

    outputs = d.select(ref(F.col("doc_id")).alias("ref"), "text")
    cases = d.select("doc_id", ref(F.col("doc_id")).alias("expected_ref"),
                     ref(F.col("doc_id") + F.col("doc_id") % 2).alias("output_ref"))
    return verify.resolve_outputs(cases, outputs).select(
        "doc_id", F.col("output_text").isNotNull().alias("resolved"), "passed")


@query("U3_schema_fallback", """
select event_id, event_id % 7 <> 0 and event_type <> 'view'
  and cast(json_extract(props, '$.k') as bigint) <= 60 as passed from events""")
def u3(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    outputs = e.filter("event_id % 7 <> 0").select(
        F.col("event_id").cast("string").alias("ref"), F.col("props").alias("text"))
    schemas = e.filter("event_type <> 'view'").select(
        F.col("event_type").alias("cluster_id"),
        F.lit('{"properties": {"k": {"maximum": 60}}}').alias("json_schema")).distinct()
    cases = e.select("event_id", F.col("event_type").alias("cluster_id"),
                     F.col("event_id").cast("string").alias("output_ref"))
    return verify.schema_fallback(cases, outputs, schemas).select("event_id", "passed")
