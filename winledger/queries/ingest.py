"""Ingest, normalisation, export."""

import uuid

from pyspark.sql import functions as F

from winledger.functions import text as tx
from winledger.operators import egress
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query
from winledger.session import ensure_checkpoint_dir
from winledger.sources import bundle
from winledger.sources import events as ev
from winledger.sources import store

SALT = "pepper"
TENANT = "t0"


def event_lines(spark, sf_dir):
    """The events table as JSON lines; every 10th is broken in one of several ways, every 7th has no
    id, and every 50th of those appears twice."""
    e = ad.table(spark, sf_dir, "events")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    m = n % 100
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    start = F.when(m == 10, iso).otherwise(F.concat(iso, F.lit("Z")))
    end = F.when(m == 20, F.lit("2001-01-01T00:00:00Z")).otherwise(F.concat(F.date_format(
        ts + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)")),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    uid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    status = F.when(F.col("event_type").isin("purchase", "signup"), "pass").when(
        F.col("event_type").isin("error", "click"), "fail")
    out = F.when(n % 4 == 0, F.col("props")).when(
        n % 4 == 1, F.concat(F.lit("```py\n"), F.col("props"), F.lit("\n```"))).when(
        n % 4 == 2, F.concat(F.lit("see ```x``` and ```y```"))).otherwise(F.col("event_type"))
    body = F.to_json(F.struct(
        F.when(m == 30, F.lit(None)).otherwise(F.lit("lab one")).alias("provider"),
        F.concat(F.lit("model "), (n % 4).cast("string")).alias("model_id"),
        start.alias("ts_start"), end.alias("ts_end"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.concat(
                F.lit("Help ticket "), n.cast("string"), F.lit(" of user a"),
                (n % 5).cast("string"), F.lit("@x.org on 2024-01-02 kind "), F.col("event_type")).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("props").alias("content"))).alias("messages"),
        out.alias("output_text"),
        F.struct(F.when(m == 40, F.lit(-1)).otherwise(F.floor("value").cast("int")).alias("input")).alias("tokens"),
        F.col("value").cast("string").alias("cost_usd"),
        F.array(F.struct(F.lit("my tool").alias("name"),
                         F.struct((n % 3).alias("b"), F.lit("x").alias("a")).alias("args"))).alias("tool_calls"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(n % 7 != 0, uid).alias("trace_id"),
        F.when(status.isNotNull(), F.struct(
            F.when(m == 50, "perhaps").otherwise(status).alias("status"), F.lit("programmatic").alias("method"),
            F.lit("flag").alias("signal"), F.lit(1.0).alias("confidence"),
            F.lit("measured").alias("evidence_grade"))).alias("verification")))
    line = F.when(m == 60, F.lit("{broken")).when(m == 70, F.lit("   ")).when(
        m == 80, F.concat(body, F.lit(" trailing"))).otherwise(body)
    copies = F.when((n % 7 == 0) & (n % 50 == 1), 2).otherwise(1)
    rows = e.select("event_id", line.alias("value"), F.sequence(F.lit(1), copies).alias("_c"))
    return rows.select("event_id", "value", F.explode("_c").alias("_n")).drop("_n")


def event_files(spark, sf_dir) -> str:
    """The lines as a folder of text files."""
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    event_lines(spark, sf_dir).select("value").write.text(folder)
    return folder


GOOD_SQL = """
V as (select *, event_id % 100 as m, event_type in ('view') as quiet,
    case when event_id % 7 = 0 and event_id % 50 = 1 then 2 else 1 end as copies from events),
OK as (select * from V where m not in (10, 20, 30, 40, 60, 70, 80) and not (m = 50 and not quiet))"""


@query("S1_read_events", f"""
with {GOOD_SQL},
B as (select case m when 10 then 'ts_start' when 20 then 'end_before_start' when 30 then 'provider'
      when 40 then 'tokens' when 50 then 'verification' else 'malformed' end as rule, copies from V
    where m in (10, 20, 30, 40, 60, 80) or (m = 50 and not quiet))
select 'ok' as rule, cast(sum(copies) as bigint) as n from OK
union all select rule, cast(sum(copies) as bigint) from B group by rule""")
def s1(spark, sf_dir):
    events, rejects = ev.read_events(spark, event_files(spark, sf_dir))
    bad = rejects.select(F.when(F.array_contains("violations", "malformed"), "malformed").otherwise(
        F.col("violations")[0]).alias("rule"))
    return events.select(F.lit("ok").alias("rule")).unionByName(bad).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"))


@query("S2_validate_events", f"""
with {GOOD_SQL}
select event_id, case m when 10 then 'ts_start' when 20 then 'end_before_start' when 30 then 'provider'
  when 40 then 'tokens' when 50 then case when quiet then '' else 'verification' end else '' end as violations
from V where m not in (60, 70, 80)""")
def s2(spark, sf_dir):
    lines = event_lines(spark, sf_dir).filter(~(F.col("event_id") % 100).isin(60, 70, 80)).distinct()
    rows = lines.withColumn("e", F.from_json("value", ev._raw_schema())).select("event_id", "e.*")
    return ev.validate_events(rows).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("S3_gateway_log", """
select event_id, 'lab' as provider, case when event_id % 5 = 0 then 'unknown' else concat('m', event_id % 4) end as model_id,
  cast(epoch_us(ts) as bigint) as start_us, cast(floor(value) as bigint) as tok_in,
  case when event_id % 2 = 0 then cast(json_extract(props, '$.k') as bigint) else 0 end as tok_cached,
  cast(cast(value as decimal(12,2)) as double) as cost_usd,
  case when event_type = 'error' then 'fail' else 'unknown' end as status,
  case when event_type = 'error' then 'api_error' else 'none' end as signal, len(event_type) as out_chars
from events""")
def s3(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    kwargs = F.to_json(F.struct(
        F.when(n % 5 != 0, F.concat(F.lit("m"), (n % 4).cast("string"))).alias("model"),
        F.lit("lab").alias("custom_llm_provider"), F.col("value").cast("decimal(12,2)").alias("response_cost"),
        n.cast("string").alias("litellm_session_id")))
    response = F.to_json(F.struct(
        F.struct(F.floor("value").cast("int").alias("prompt_tokens"),
                 F.when(n % 2 == 0, F.struct(k.alias("cached_tokens"))).alias("prompt_tokens_details")).alias("usage"),
        F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("message"))).alias("choices")))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    log = e.select(kwargs.alias("kwargs"), response.alias("response"), stamp.alias("start"),
                   F.concat(stamp, F.lit("+00:00")).alias("end"), (F.col("event_type") == "error").alias("failed"))
    t = ev.normalize(ev.with_ids(ev.events_from_gateway_log(log), TENANT), TENANT, SALT)
    return t.select(
        F.col("session_id").cast("long").alias("event_id"), "provider", "model_id",
        F.unix_micros("ts_start").alias("start_us"), F.col("tokens.input").alias("tok_in"),
        F.col("tokens.input_cached").alias("tok_cached"), num("cost_usd", "cost_usd"),
        F.col("verification.status").alias("status"), F.col("verification.signal").alias("signal"),
        F.col("output_shape.n_chars").alias("out_chars"))


@query("S4_normalize", f"""
with {GOOD_SQL}
select case when event_id % 7 <> 0 then concat('00000000-0000-4000-8000-', lpad(cast(event_id as varchar), 12, '0')) end
    as trace_id,
  'lab-one' as provider, concat('model-', event_id % 4) as model_id, cast(epoch_us(ts) as bigint) as start_us,
  cast(floor(value) as bigint) * 1000 as total_ms, 2 as n_messages, 'my-tool' as tool,
  cast(user_id as varchar) as session_id, cast(floor(value) as bigint) as tok_in, cast(value as double) as cost_usd,
  case when quiet then 'unknown' when event_type in ('purchase','signup') then 'pass' else 'fail' end as status,
  (['json','code','mixed','text'])[event_id % 4 + 1] as out_type
from (select *, unnest(range(copies)) as nth from OK)""")
def s4(spark, sf_dir):
    traces, _ = ev.ingest(ev.read_lines(spark, event_files(spark, sf_dir)), TENANT, SALT)
    given = F.when(F.col("trace_id").startswith("00000000-"), F.col("trace_id"))  # the others are made of their places
    return traces.select(
        given.alias("trace_id"), "provider", "model_id", F.unix_micros("ts_start").alias("start_us"),
        F.col("latency.total_ms").alias("total_ms"), F.col("input_shape.n_messages").cast("int").alias("n_messages"),
        F.col("tool_calls")[0]["name"].alias("tool"), "session_id", F.col("tokens.input").alias("tok_in"),
        F.col("cost_usd").cast("double").alias("cost_usd"), F.col("verification.status").alias("status"),
        F.col("output_shape.type").alias("out_type"))


@query("S4_ids_of_copies", f"""
with {GOOD_SQL} select event_id % 7 as kind, copies, count(*) * 2 as n, count(*) * 2 as n_ids from (
  select *, unnest(range(copies)) as nth from OK) where event_id % 7 = 0 group by all""")
def s4_ids(spark, sf_dir):
    """Lines without an id, in two folders with equal files: all keep their own, the same when they are read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    for day in ("a", "b"):
        event_lines(spark, sf_dir).filter("event_id % 7 = 0").select("value").repartition(3).write.text(f"{folder}/{day}")
    once, again = (ev.ingest(ev.read_lines(spark, f"{folder}/{glob}"), TENANT, SALT)[0] for glob in ("*", "[ab]"))
    line = F.struct("ts_start", "session_id", "model_id", "cost_usd", F.col("output_shape.n_chars"))
    both = once.withColumn("_l", line).join(again.select(F.col("trace_id").alias("_again")), F.col("trace_id") == F.col("_again"))
    lines = both.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("n_ids"))
    return lines.groupBy(F.lit(0).cast("long").alias("kind"), F.expr("cast(n div 2 as int)").alias("copies")).agg(
        F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))


@query("S5_fingerprint", f"select doc_id, concat('sha256:', sha256(concat('{SALT}', text))) as fp from documents")
def s5(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text"), SALT).alias("fp"))


@query("S6_strip_variables", r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'gi'),
  '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '<email>', 'g'), 'https?://[^\s]+', '<url>', 'g'),
  '\d{4}-\d{2}-\d{2}([T ][\d:.]+Z?)?', '<ts>', 'g'), '\d+', '<n>', 'g')) as digest from documents""")
def s6(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.strip_variables(F.col("text"))).alias("digest"))


@query("S7_output_shape", f"""
with O as (select event_id, case event_id % 4 when 0 then props when 1 then concat(E'```py\\n', props, E'\\n```')
    when 2 then 'see ```x``` and ```y```' else event_type end as o, event_id % 4 as m from events)
select event_id, (['json','code','mixed','text'])[m + 1] as type, len(o) as n_chars, m = 0 as json_valid,
  case when m = 0 then concat('sha256:', sha256(concat('{SALT}', '{{"k": "int"}}'))) end as schema_fp,
  cast(case m when 1 then 1 when 2 then 2 else 0 end as bigint) as n_code_blocks from O""")
def s7(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    n = F.col("event_id")
    out = F.when(n % 4 == 0, F.col("props")).when(
        n % 4 == 1, F.concat(F.lit("```py\n"), F.col("props"), F.lit("\n```"))).when(
        n % 4 == 2, F.lit("see ```x``` and ```y```")).otherwise(F.col("event_type"))
    return e.select("event_id", ev.output_shape(out, SALT).alias("s")).select(
        "event_id", "s.type", "s.n_chars", "s.json_valid", F.col("s.schema_fingerprint").alias("schema_fp"),
        "s.n_code_blocks")


@query("S8_merge_traces", """
with A as (select event_id % 3000 as id, event_id, value from events),
W as (select id, arg_max({'e': event_id, 'v': value}, case when event_id < 3000 then -1 else event_id end) as r
      from A group by id)
select cast(id as varchar) as trace_id, r.e as last_event, round(r.v, 6) as cost_usd from W""")
def s8(spark, sf_dir):
    a = ad.attempts_from_events(spark, sf_dir)
    n = F.col("trace_id").cast("long")
    rows = a.withColumn("seq", n).withColumn("task_id", n.cast("string")).withColumn(
        "trace_id", (n % 3000).cast("string"))
    old, new = rows.filter("seq < 3000").drop("seq"), rows.filter("seq >= 3000")
    return ev.merge_traces(old, new, seq="seq").select(
        "trace_id", F.col("task_id").cast("long").alias("last_event"), num("cost_usd", "cost_usd"))


@query("S8_upsert_stored", """
with A as (select event_id % 3000 as id, event_id, value, ts from events),
W as (select id, arg_max({'e': event_id, 'v': value, 't': ts}, case when event_id < 3000 then -1 else event_id end) as r
      from A group by id)
select cast(id as varchar) as trace_id, r.e as last_event, round(r.v, 6) as cost_usd, cast(epoch_us(r.t) as bigint) as start_us from W""")
def s8_stored(spark, sf_dir):
    """The first 3000 events are stored by day; the others are upserted in two rounds, and the table is read back."""
    a = ad.attempts_from_events(spark, sf_dir)
    n = F.col("trace_id").cast("long")
    rows = a.withColumn("seq", n).withColumn("task_id", n.cast("string")).withColumn("trace_id", (n % 3000).cast("string"))
    path = f"{ensure_checkpoint_dir(spark)}/traces-{uuid.uuid4().hex}"
    store.write_traces(rows.filter("seq < 3000").drop("seq"), path)
    for low, high in ((3000, 5000), (5000, 1 << 60)):
        store.upsert_traces(rows.filter((F.col("seq") >= low) & (F.col("seq") < high)), path, seq="seq")
    return store.read_traces(spark, path).select(
        "trace_id", F.col("task_id").cast("long").alias("last_event"), num("cost_usd", "cost_usd"),
        F.unix_micros("ts_start").alias("start_us"))


@query("P1_slugify", r"""
with S as (select doc_id, trim(regexp_replace(trim(text, E' \n\t\r'), '[^A-Za-z0-9.:/+_-]+', '-', 'g'), '-')[1:40] as s
  from documents)
select doc_id, case when s = '' then 'unknown' else s end as slug from S""")
def p1(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", tx.slugify(F.col("text"), 40).alias("slug"))


@query("P2_scan_metadata_only", r"""
with D as (select doc_id, text, len(text) as n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 8
    and len(text) - len(replace(text, ' ', '')) > 6 as prose from documents)
select doc_id, case when n > 60 or prose then 1 else 0 end + case when n > 256 or prose then 2 else 0 end
  + case when n > 40 or contains(trim(text), ' ') or len(regexp_split_to_array(trim(text), '[-_./: ]+')) > 7 then 1 else 0 end
  as n_findings from D""")
def p2(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.struct(F.col("text").alias("note")).alias("a"),
        F.array(F.struct(F.array("text").alias("free"), F.col("text").alias("provider"))).alias("b"),
        F.create_map(F.lit("blob"), F.col("text"), F.lit("label"), F.lit("short")).alias("c"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("fp"))
    return egress.scan_metadata_only(d).select("doc_id", F.size("findings").alias("n_findings"))


def _fold_sql(levels: int) -> str:
    """Digests (i, d) in L0 folded level by level."""
    return "".join(f""",
L{k} as (select i // {bundle.FANOUT} as i, sha256(string_agg(d, '' order by i)) as d from L{k - 1} group by i // {bundle.FANOUT})"""
                   for k in range(1, levels + 1))


@query("S16_bundle", f"""
with L0 as (select row_number() over (order by d) - 1 as i, d from (
  select sha256(concat('{{"order_id":"', o_orderkey, '","customer":"', o_custkey, '"',
    case when o_orderkey % 3 = 0 then concat(',"cost_usd":', round(o_totalprice, 2)::decimal(15,2)) else '' end, '}}')) as d
  from orders)){_fold_sql(3)}
select 'orders' as section, (select count(*) from L0) as n_rows,
  case when (select count(*) from L0) <= 256
  then (select max(d) from L1) when (select count(*) from L0) <= 65536 then (select max(d) from L2) else (select max(d) from L3) end as root,
  0 as n_before, 1 as n_after""")
def s16(spark, sf_dir):
    """Exports a section, verifies, adds a file, verifies again; the root is that of the rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    o = ad.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("decimal(15,2)")).alias("cost_usd"))
    made = bundle.write_bundle({"orders": rows}, folder, {"tenant_id": "t0"})["sections"]["orders"]
    before = bundle.verify_bundle(spark, folder).count()
    rows.limit(1).coalesce(1).write.mode("append").json(f"{folder}/orders")
    after = bundle.verify_bundle(spark, folder).count()
    return spark.createDataFrame([("orders", made["rows"], made["root"], before, after)],
                                 "section string, n_rows long, root string, n_before int, n_after int")
