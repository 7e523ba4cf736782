"""Streams over the events table, run to its end and read back."""

import uuid

from pyspark.sql import functions as F

from winledger.operators import caps, guard
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query
from winledger.queries.guarding import GUARD_SQL, POLICY, VERDICT_OUT_SQL, guard_events, verdict_sql
from winledger.queries.ingest import GOOD_SQL, SALT, TENANT, event_lines
from winledger.queries.tasks import EVENT_GAP_S, EVENT_TASKS_SQL
from winledger.session import SETTINGS, ensure_checkpoint_dir
from winledger.sources import store
from winledger.streaming import caps as live_caps
from winledger.streaming import flows, stateful

ROCKS = "spark.sql.streaming.stateStore.providerClass"


def place(spark) -> str:
    """A new folder next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


class _Streamed:
    """Makes the adapters read the named table as a stream."""

    def __init__(self, spark, sf_dir):
        self.read, self.spark, self.sf_dir = self, spark, sf_dir

    def parquet(self, path):
        return table_stream(self.spark, self.sf_dir, path.rsplit("/", 1)[1].removesuffix(".parquet"))


def drained(spark, stream):
    """Run a stream over what is there and read its result."""
    spark.conf.set(ROCKS, SETTINGS[ROCKS])
    folder = place(spark)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("T1_stream_traces", f"""
with {GOOD_SQL}
select 'trace' as kind, case when event_id % 7 <> 0 then concat('00000000-0000-4000-8000-', lpad(cast(event_id as varchar), 12, '0')) end
  as trace_id, concat('model-', event_id % 4) as model_id, cast(epoch_us(ts) as bigint) as start_us,
  cast(user_id as varchar) as session_id, cast(floor(value) as bigint) as tok_in, cast(value as double) as cost_usd
from (select *, unnest(range(copies)) as nth from OK)
union all select case m when 10 then 'ts_start' when 20 then 'end_before_start' when 30 then 'provider'
  when 40 then 'tokens' when 50 then 'verification' else 'malformed' end, null, null, null, null, null, null
from (select *, unnest(range(copies)) as nth from V where m in (10, 20, 30, 40, 60, 80) or (m = 50 and not quiet))""")
def t1(spark, sf_dir):
    folder = place(spark)
    event_lines(spark, sf_dir).select("value").repartition(7).write.text(f"{folder}/in")
    flows.stream_traces(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ckpt", TENANT, SALT, max_files=3,
                        availableNow=True).awaitTermination()
    given = F.when(F.col("trace_id").startswith("00000000-"), F.col("trace_id"))  # the others are made of their places
    traces = store.read_traces(spark, f"{folder}/out/traces").select(
        F.lit("trace").alias("kind"), given.alias("trace_id"), "model_id", F.unix_micros("ts_start").alias("start_us"), "session_id",
        F.col("tokens.input").alias("tok_in"), F.col("cost_usd").cast("double").alias("cost_usd"))
    none = F.lit(None)
    rejects = spark.read.parquet(f"{folder}/out/rejects").select(
        F.when(F.array_contains("violations", "malformed"), "malformed").otherwise(F.col("violations")[0]).alias("kind"),
        none.cast("string").alias("trace_id"), none.cast("string").alias("model_id"), none.cast("long").alias("start_us"),
        none.cast("string").alias("session_id"), none.cast("long").alias("tok_in"), none.cast("double").alias("cost_usd"))
    return traces.unionByName(rejects)


def _records(spark, sf_dir, stream=False):
    """Events as session-log records."""
    e = table_stream(spark, sf_dir, "events") if stream else ad.table(spark, sf_dir, "events")
    kind, k, n = F.col("event_type"), F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    usage = F.format_string(
        '{"output_tokens":%d,"input_tokens":%d,"cache_creation_input_tokens":5,"cache_read_input_tokens":%d,'
        '"output_tokens_details":{"thinking_tokens":%d}}', F.floor("value").cast("long"), k, k * 10, k)
    blocks = F.format_string(
        '[{"type":"text","text":"step %d"},{"type":"tool_use","name":"%s","input":{"z":%d,"cmd":"cat /etc/p%d"}},'
        '{"type":"thinking","text":"x"}]', k % 2, F.when(n % 2 == 0, "Edit").otherwise("Bash"), k % 2, k % 3)
    stamp = F.when(n % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(
        F.concat(F.lit('"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z"')))
    model = F.when(n % 5 == 0, "").otherwise('"model":"claude-opus-5",')
    assistant = F.concat(F.lit('{"type":"assistant","timestamp":'), stamp, F.lit(',"message":{'), model, F.lit('"usage":'), usage, F.lit(',"content":'), blocks, F.lit("}}"))
    result = F.concat(F.lit('{"type":"user","timestamp":'), stamp, F.lit(
        ',"message":{"content":[{"type":"tool_result","content":"'),
        F.when(k % 2 == 0, "7 passed").otherwise("failed"), F.lit('"}]}}'))
    human = F.concat(F.lit('{"type":"user","timestamp":'), stamp, F.lit(',"message":{"content":"go on"}}'))
    return e.select(
        F.lit("t0").alias("tenant_id"), F.col("user_id").cast("string").alias("session_id"),
        n.alias("line"), F.lit(0.0).alias("received_at"),
        F.when(kind.isin("view", "click"), assistant).when(kind == "error", result)
        .when(kind == "signup", human).otherwise('{"type":"system"}').alias("raw"))


T2_SQL = """
with R as (select *, cast(json_extract(props, '$.k') as bigint) as k, cast(floor(value) as bigint) as o,
    event_id * 2147483648 as place from events),
A as (select *, count(*) filter (where event_id % 5 <> 0) over (partition by user_id order by event_id rows unbounded preceding) > 0
    as priced from R where event_type in ('view', 'click'))
select place as event_id, 'assistant' as kind, o as out_tokens, k + 5 as in_tokens, k as thinking_tokens,
  case when priced then round(((k + 5 + k * 10 * 0.1e0) * 5 + o * 25) / 1e6, 9) else 0e0 end as cost_usd, concat('step ', k % 2) as text, '' as tool,
  '' as tool_args, false as progress, cast(epoch_us(ts) // 1000 as bigint) as ts_ms from A
union all select place + 1, 'tool', 0, 0, 0, 0e0, '', case when event_id % 2 = 0 then 'Edit' else 'Bash' end,
  concat('{"cmd":"cat /etc/p', k % 3, '","z":', k % 2, '}'), event_id % 2 = 0, cast(epoch_us(ts) // 1000 as bigint) from A
union all select place, 'progress', 0, 0, 0, 0e0, '', '', '', k % 2 = 0, cast(epoch_us(ts) // 1000 as bigint)
  from R where event_type = 'error'
union all select place, 'user', 0, 0, 0, 0e0, '', '', '', true, cast(epoch_us(ts) // 1000 as bigint)
  from R where event_type = 'signup'"""


def _session_rows(e):
    return e.select("event_id", "kind", "out_tokens", "in_tokens", "thinking_tokens", num("cost_usd", "cost_usd", 9),
                    "text", "tool", "tool_args", "progress", F.round(F.col("ts") * 1000).cast("long").alias("ts_ms"))


@query("T2_session_events", T2_SQL)
def t2(spark, sf_dir):
    return _session_rows(drained(spark, flows.session_events(stateful.carry_models(_records(spark, sf_dir, stream=True)))))


@query("T2_logged_events", T2_SQL)
def t2_batch(spark, sf_dir):
    return _session_rows(flows.session_events(_records(spark, sf_dir), carry_model=True))


def _expected(spark, sf_dir):
    """The fixed expectations of ``verdict_sql``, for every model of the events."""
    models = guard_events(spark, sf_dir).select("model_id").distinct()
    return models.select("model_id", F.lit(2.5).alias("expected_cost_usd"), F.lit(400000.0).alias("expected_seconds"))


@query("T3_stream_stalls", f"""
with {GUARD_SQL}, {verdict_sql('ts')}
select session_id, event_id, state, cast(score as bigint) as score, cast(loops as bigint) as tool_loops,
  round(ratio, 6) as repeat_ratio, hard as working_hard from VE""")
def t3(spark, sf_dir):
    e = guard_events(_Streamed(spark, sf_dir), sf_dir)
    out = drained(spark, stateful.stream_stalls(e, POLICY, _expected(spark, sf_dir), time_mode="None"))
    return out.select("session_id", "event_id", "state", "score", "tool_loops", num("repeat_ratio", "repeat_ratio"),
                      "working_hard")


@query("T3_stream_silence", f"""
with {GUARD_SQL},
GL as (select * from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as back
  from GS) where back = 1),
GQ as (select * exclude (ts), ts, ts + 86400 as woken, (select max(ts) from G) - 60 as mark from GL),
{verdict_sql('woken', 'GQ')}
select session_id, state, cast(score as bigint) as score, cast(floor(woken) as bigint) as woken_s from VE where woken <= mark""")
def t3_silence(spark, sf_dir):
    e = guard_events(_Streamed(spark, sf_dir), sf_dir)
    out = drained(spark, stateful.stream_stalls(e, POLICY, _expected(spark, sf_dir), forget_s=400 * 86400.0))
    return out.where("event_id IS NULL").select("session_id", "state", "score", F.floor("ts").alias("woken_s"))


@query("T4_stream_findings", """
with R as (select distinct cast(user_id as varchar) as session_id, cast(json_extract(props, '$.k') as bigint) % 3 as p
  from events where event_type in ('view', 'click'))
select session_id, 'outside_workspace' as kind, concat('/etc/p', p) as snippet from R""")
def t4(spark, sf_dir):
    texts = flows.outbound_text(_records(spark, sf_dir, stream=True))
    return drained(spark, flows.stream_findings(texts, {"allowed_roots": ["/work"]})).select(
        "session_id", "kind", "snippet")


CAPS = {"session_budget_usd": 2.0, "daily_budget_usd": 5.0, "action": "stop"}
# A recursion over the days: what a session brings into a day is what it was let through before.
_DAY_SQL = """
  (select *, sum(take) over (partition by tenant_id, di order by ts, event_id rows unbounded preceding) as dayrun from (
    select *, case when before < 2 then cost else 0 end as take from (
      select GE.*, R.spent as carry, R.spent + sum(cost) over (partition by GE.tenant_id, GE.session_id, GE.di
        order by ts, event_id rows unbounded preceding) - cost as before
      from GE join R on R.tenant_id = GE.tenant_id and R.session_id = GE.session_id and GE.di = R.di + 1)))"""
STOP_SQL = f"""
with recursive {GUARD_SQL},
GE as (select tenant_id, session_id, event_id, ts, cost, dense_rank() over (order by cast(floor(ts / 86400) as bigint)) as di from G),
R(di, tenant_id, session_id, spent) as (
  select distinct 0::bigint, tenant_id, session_id, 0::decimal(38,4) from GE
  union all
  select R.di + 1, R.tenant_id, R.session_id, R.spent + coalesce(got, 0)
  from R left join (select tenant_id, session_id, cast(sum(cost) as decimal(38,4)) as got from {_DAY_SQL}
    where before < 2 and dayrun - take < 5 group by all) A using (tenant_id, session_id)
  where R.di < (select max(di) from GE)),
X as (select *, before < 2 and dayrun - take < 5 as ok from {_DAY_SQL}),
Y as (select *, carry + sum(case when ok then cost else 0 end) over (partition by tenant_id, session_id, di order by ts, event_id
    rows unbounded preceding) as s, sum(case when ok then cost else 0 end) over (partition by tenant_id, di order by ts, event_id
    rows unbounded preceding) as d from X)
select session_id, event_id, case when not ok then 'refused' when s >= 2 or d >= 5 then 'alert' else 'ok' end as verdict,
  case when s >= 2 then 'session budget' when d >= 5 then 'daily budget' else '' end as cap,
  cast(s as double) as session_spent, cast(d as double) as day_spent from Y"""


def _caps(told):
    return told.select("session_id", "event_id", "verdict", "cap", F.col("session_spent").cast("double").alias("session_spent"),
                       F.col("day_spent").cast("double").alias("day_spent"))


@query("T5_stop_caps", STOP_SQL)
def t5_stop(spark, sf_dir):
    return _caps(caps.stopped_caps(guard_events(spark, sf_dir), CAPS))


@query("T5_stream_caps", STOP_SQL)
def t5_stream(spark, sf_dir):
    e, folder = guard_events(_Streamed(spark, sf_dir), sf_dir), place(spark)
    live_caps.stream_caps(e, f"{folder}/out", f"{folder}/ckpt", CAPS, availableNow=True).awaitTermination()
    return _caps(spark.read.parquet(f"{folder}/out"))


@query("T6_stream_tasks", f"""
with {EVENT_TASKS_SQL}, MX as (select max(ts_start) as hi from EC), LE as (
  select task_key, arg_max(ts_end, (ts_start, trace_id)) as last_end from EC group by task_key)
select task_id, attempts, succeeded, first_ok as first_attempt_success, cast(cost as double) as total_cost_usd,
  wall as total_wall_ms, array_to_string(models, ',') as models_used
from ETM join LE on task_key = task_id, MX
where epoch_us(last_end) + {EVENT_GAP_S * 1000000} < epoch_us(hi) - 600000000""")
def t6(spark, sf_dir):
    a = ad.attempts_from_events(_Streamed(spark, sf_dir), sf_dir)
    out = drained(spark, stateful.stream_tasks(a, gap_s=EVENT_GAP_S))
    return out.select("task_id", "attempts", "succeeded", "first_attempt_success",
                      F.col("total_cost_usd").cast("double").alias("total_cost_usd"), "total_wall_ms",
                      F.array_join("models_used", ",").alias("models_used"))


@query("T7_stream_windows", f"""
with {ad.EVENTS_SQL}, MX as (select max(ts_start) as hi from E where status <> 'unknown')
select model_id, concat('c', user_id % 3) as cluster_id, cast(epoch_us(date_trunc('hour', ts_start)) as bigint) as ts_us,
  count(*) as n, count(*) filter (where status = 'pass') as successes
from E, MX where status <> 'unknown' and date_trunc('hour', ts_start) + interval '1 hour' <= hi - interval '1 hour'
group by all""")
def t7(spark, sf_dir):
    a = ad.attempts_from_events(_Streamed(spark, sf_dir), sf_dir)
    tasks = a.select(
        "model_id", F.concat(F.lit("c"), (F.col("session_id").cast("long") % 3).cast("string")).alias("cluster_id"),
        "ts_start", (F.col("verification.status") == "pass").alias("succeeded"),
        F.when(F.col("verification.status") == "unknown", "unknown").otherwise("measured").alias("verification_grade"))
    return drained(spark, flows.stream_windows(tasks)).select(
        "model_id", "cluster_id", F.unix_micros("ts").alias("ts_us"), "n", "successes")


@query("T8_write_alerts", f"""
with {GUARD_SQL}, {verdict_sql('ts')},
C as (select *, lag(state, 1, 'ok') over (partition by session_id order by ts, event_id) as was from VE)
select session_id, event_id, case when state in ('stalled', 'burning') then state else 'warn' end as level
from C where was <> state and (state in ('stalled', 'burning') or (state = 'watch' and hard))""")
def t8(spark, sf_dir):
    spark.conf.set(ROCKS, SETTINGS[ROCKS])
    e = guard_events(_Streamed(spark, sf_dir), sf_dir)
    v = stateful.stream_stalls(e, POLICY, _expected(spark, sf_dir), time_mode="None").filter("changed")
    note = guard.alert_columns(F.col("state"), F.col("working_hard"), F.col("reasons"), F.col("spent_usd"))
    alerts = v.withColumn("_a", note).filter(F.col("_a").isNotNull()).select(
        "session_id", "event_id", "ts", "_a.*")
    folder = place(spark)
    flows.write_alerts(alerts, f"{folder}/alerts", f"{folder}/ckpt", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/alerts").filter(
        F.get_json_object("payload", "$.text").isNotNull()).select("session_id", "event_id", "level")
