"""Driver tables read as attempts, so the operators can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.schema import TRACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, in the splits its files give."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _as_traces(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACE.fields])


def attempts_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line is an attempt at the task of its order."""
    d = table(spark, sf_dir, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    qty = F.col("l_quantity")
    status = (
        F.when((F.col("l_returnflag") == "A")
               | ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")), "pass")
        .when(F.col("l_returnflag") == "R", "fail").otherwise("unknown")
    )
    kind = (
        F.when(part % 7 <= 3, "json").when(part % 7 == 4, "text").when(part % 7 == 5, "code")
        .otherwise("mixed")
    )

    def call(when, name):
        one = F.array(F.lit(name))
        return F.when(when, one).otherwise(F.array().cast("array<string>"))

    names = F.concat(
        call(part % 2 == 0, "search"), call(part % 3 == 0, "read"), call(supp % 2 == 0, "edit"),
        call(line % 2 == 0, "test"), call(supp % 5 == 0, "search"),
    )
    none = F.lit(None)
    return _as_traces(d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trace_id"),
        _named("t", F.col("l_orderkey") % 2).alias("tenant_id"),
        F.col("l_orderkey").cast("string").alias("task_id"),
        F.lit(1).alias("attempt_no"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(mins=line)).alias("ts_start"),
        (F.col("l_shipdate").cast("timestamp")
         + F.make_dt_interval(mins=line, secs=qty.cast("decimal(18,6)"))).alias("ts_end"),
        F.lit("lab").alias("provider"),
        _named("model-", supp % 5).alias("model_id"),
        F.lit("unknown").alias("model_version_hint"),
        F.lit("unknown").alias("endpoint_region"),
        F.struct(
            (qty.cast("long") * 1000).alias("input"),
            F.round(qty * 1000 * F.col("l_tax")).cast("long").alias("input_cached"),
            (part % 1500 + 50).alias("output"),
            (part % 4000).alias("reasoning"),
        ).alias("tokens"),
        (F.col("l_extendedprice").cast("decimal(12,2)")
         * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")))
        .alias("cost_usd"),
        F.struct((line * 10).alias("ttft_ms"), (qty.cast("long") * 1000).alias("total_ms"))
        .alias("latency"),
        F.struct(
            line.alias("n_messages"),
            (part % 900).alias("n_chars"),
            F.lit(False).alias("has_attachments"),
            _named("tpl-", part % 12).alias("system_prompt_fingerprint"),
            _named("in-", part % 500).alias("input_fingerprint"),
        ).alias("input_shape"),
        F.struct(
            kind.alias("type"),
            (part * 37 % 5000).alias("n_chars"),
            (part % 7 <= 3).alias("json_valid"),
            F.when(part % 7 <= 3, _named("schema-", supp % 3)).alias("schema_fingerprint"),
            (part % 7 >= 5).alias("has_code_block"),
            (part % 7 >= 5).cast("long").alias("n_code_blocks"),
        ).alias("output_shape"),
        F.transform(names, lambda n: F.struct(
            n.alias("name"), F.lit("sha256:-").alias("args_fingerprint"),
            F.lit(0).cast("long").alias("ts_offset_ms"), F.lit(0).cast("long").alias("duration_ms"),
            F.lit("ok").alias("status"),
        )).alias("tool_calls"),
        F.struct(
            status.alias("status"),
            F.lit("programmatic").alias("method"),
            F.lit("flag").alias("signal"),
            F.when(status == "unknown", 0.0).otherwise(1.0).alias("confidence"),
            F.when(status == "unknown", "declared").when(line % 3 == 0, "derived")
            .otherwise("measured").alias("evidence_grade"),
        ).alias("verification"),
        F.lit("metadata_only").alias("redaction_level"),
        F.lit("1.0").alias("schema_version"),
        none.alias("session_id"),
        F.col("l_orderkey").cast("string").alias("explicit_task_id"),
        none.alias("input_shingles"),
    ))


def attempts_from_events(spark: SparkSession, sf_dir: str, *, shingles: bool = False) -> DataFrame:
    """Each event is an attempt in the session of its user, without a task id."""
    d = table(spark, sf_dir, "events")
    eid, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "signup"), "pass").when(kind.isin("error", "click"), "fail")
        .otherwise("unknown")
    )
    seconds = F.floor("value").cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    grams = F.array(
        _named("a", user), _named("b", user % 7), _named("c", user % 5), _named("d", k % 2),
        _named("e", user % 3), _named("f", user % 2), _named("g", user % 11),
        _named("h", user % 13), _named("i", user % 17), _named("j", user % 19),
    )
    none = F.lit(None)
    return _as_traces(d.select(
        eid.cast("string").alias("trace_id"),
        F.lit("t0").alias("tenant_id"),
        eid.cast("string").alias("task_id"),
        F.lit(1).alias("attempt_no"),
        ts.alias("ts_start"),
        (ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("ts_end"),
        F.lit("lab").alias("provider"),
        _named("model-", eid % 4).alias("model_id"),
        F.lit("unknown").alias("model_version_hint"),
        F.lit("unknown").alias("endpoint_region"),
        F.struct(
            (seconds * 10).alias("input"), F.lit(0).cast("long").alias("input_cached"),
            (seconds * 3).alias("output"), (eid % 700).alias("reasoning"),
        ).alias("tokens"),
        F.col("value").cast("decimal(12,2)").alias("cost_usd"),
        F.struct(F.lit(0).cast("long").alias("ttft_ms"), (seconds * 1000).alias("total_ms"))
        .alias("latency"),
        F.struct(
            F.lit(1).cast("long").alias("n_messages"), (eid % 300).alias("n_chars"),
            F.lit(False).alias("has_attachments"),
            _named("tpl-", (user + F.dayofmonth(ts)) % 3).alias("system_prompt_fingerprint"),
            _named("in-", eid % 50).alias("input_fingerprint"),
        ).alias("input_shape"),
        F.struct(
            F.lit("text").alias("type"), (eid % 2000).alias("n_chars"),
            F.lit(False).alias("json_valid"), none.cast("string").alias("schema_fingerprint"),
            F.lit(False).alias("has_code_block"), F.lit(0).cast("long").alias("n_code_blocks"),
        ).alias("output_shape"),
        F.array().alias("tool_calls"),
        F.struct(
            status.alias("status"), F.lit("programmatic").alias("method"),
            kind.alias("signal"),
            F.when(status == "unknown", 0.0).otherwise(1.0).alias("confidence"),
            F.when(status == "unknown", "declared").otherwise("measured").alias("evidence_grade"),
        ).alias("verification"),
        F.lit("metadata_only").alias("redaction_level"),
        F.lit("1.0").alias("schema_version"),
        user.cast("string").alias("session_id"),
        none.alias("explicit_task_id"),
        (grams if shingles else none).alias("input_shingles"),
    ))


def prices_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price list for four of the five models; the fifth stays unpriced."""
    d = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 4)
    unit = (F.col("n_regionkey") + 1).cast("decimal(8,2)")
    return d.select(
        _named("model-", F.col("n_nationkey")).alias("model_id"),
        (unit * F.lit("0.50").cast("decimal(4,2)")).alias("input_per_mtok"),
        (unit * F.lit("2.00").cast("decimal(4,2)")).alias("output_per_mtok"),
    )


# The same adapters as SQL text for the oracle, as common table expressions.
LINEITEM_SQL = """
L as (
  select concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) as trace_id,
    concat('t', l_orderkey % 2) as tenant_id,
    cast(l_orderkey as varchar) as task_id,
    concat('model-', l_suppkey % 5) as model_id,
    concat('tpl-', l_partkey % 12) as template,
    concat('in-', l_partkey % 500) as input_fp,
    l_shipdate + l_linenumber * interval '1 minute' as ts_start,
    l_shipdate + l_linenumber * interval '1 minute'
      + cast(l_quantity as bigint) * interval '1 second' as ts_end,
    cast(l_extendedprice as decimal(12,2))
      * (cast(1 as decimal(3,2)) - cast(l_discount as decimal(3,2))) as cost,
    cast(l_quantity as bigint) * 1000 as wall,
    cast(l_quantity as bigint) * 1000 as tok_in,
    cast(round(l_quantity * 1000 * l_tax) as bigint) as tok_cached,
    l_partkey % 1500 + 50 as tok_out,
    l_partkey % 4000 as reasoning,
    case when l_returnflag = 'A' or (l_returnflag = 'N' and l_linestatus = 'O') then 'pass'
         when l_returnflag = 'R' then 'fail' else 'unknown' end as status,
    case when l_linenumber % 3 = 0 then 1 else 0 end as grade_no,
    case when l_partkey % 7 <= 3 then 'json' when l_partkey % 7 = 4 then 'text'
         when l_partkey % 7 = 5 then 'code' else 'mixed' end as out_type,
    (l_partkey * 37) % 5000 as out_chars,
    l_partkey % 7 <= 3 as json_valid,
    case when l_partkey % 7 <= 3 then concat('schema-', l_suppkey % 3) end as schema_fp,
    l_partkey % 7 >= 5 as has_code,
    list_concat(
      case when l_partkey % 2 = 0 then ['search'] else [] end,
      case when l_partkey % 3 = 0 then ['read'] else [] end,
      case when l_suppkey % 2 = 0 then ['edit'] else [] end,
      case when l_linenumber % 2 = 0 then ['test'] else [] end,
      case when l_suppkey % 5 = 0 then ['search'] else [] end) as tools
  from lineitem)"""

LINEITEM_TASKS_SQL = LINEITEM_SQL + """,
LM as (
  select tenant_id, task_id, model_id, min((ts_start, trace_id)) as first_at
  from L group by all),
LMO as (
  select tenant_id, task_id, list(model_id order by first_at) as models from LM group by all),
LT0 as (
  select tenant_id, task_id, count(*) as attempts, bool_or(status = 'pass') as succeeded,
    arg_min(status, (ts_start, trace_id)) = 'pass' as first_ok,
    sum(cost) as cost, cast(sum(wall) as bigint) as wall,
    cast(sum(tok_in) as bigint) as tok_in, cast(sum(tok_out) as bigint) as tok_out,
    cast(sum(reasoning) as bigint) as tok_think,
    min(case when status <> 'unknown' then grade_no end) as g,
    count(*) filter (where status = 'fail') as failed_n,
    coalesce(sum(case when status = 'fail' then cost end), 0) as failed_cost,
    min(ts_start) as ts_start, arg_min(trace_id, (ts_start, trace_id)) as first_trace_id
  from L group by all),
LT as (
  select LT0.*, models, models[-1] as finisher,
    case g when 0 then 'measured' when 1 then 'derived' else 'unknown' end as grade,
    g is not null as known
  from LT0 join LMO using (tenant_id, task_id))"""

EVENTS_SQL = """
E as (
  select cast(event_id as varchar) as trace_id, cast(user_id as varchar) as session_id,
    event_id, user_id, event_type, value,
    concat('model-', event_id % 4) as model_id,
    concat('tpl-', (user_id + day(ts)) % 3) as template,
    ts as ts_start, ts + cast(floor(value) as bigint) * interval '1 second' as ts_end,
    cast(value as decimal(12,2)) as cost,
    cast(floor(value) as bigint) * 1000 as wall,
    cast(floor(value) as bigint) * 10 as tok_in, cast(floor(value) as bigint) * 3 as tok_out,
    event_id % 700 as reasoning,
    case when event_type in ('purchase','signup') then 'pass'
         when event_type in ('error','click') then 'fail' else 'unknown' end as status,
    cast(json_extract(props, '$.k') as bigint) as k
  from events)"""

PRICES_SQL = """
P as (
  select concat('model-', n_nationkey) as model_id,
    cast(n_regionkey + 1 as decimal(8,2)) * cast(0.5 as decimal(4,2)) as p_in,
    cast(n_regionkey + 1 as decimal(8,2)) * cast(2 as decimal(4,2)) as p_out
  from nation where n_nationkey < 4)"""
