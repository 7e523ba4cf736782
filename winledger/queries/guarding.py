"""Leaks, stalls, spend, policies."""

from pyspark.sql import functions as F

from winledger.functions.text import trigram_overlap
from winledger.operators import guard
from winledger.plans import adapters as ad
from winledger.queries import cnt, num, query

POLICY = {"silence_s": 86400.0, "session_budget_usd": 8.0, "daily_budget_usd": 0.0,
          "max_thinking_ratio": 7.0}


def guard_events(spark, sf_dir):
    """Events as session activity: views are turns, clicks and errors tool calls, purchases
    progress, signups human turns."""
    e = ad.table(spark, sf_dir, "events")
    kind, k, user = F.col("event_type"), F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
    tool = kind.isin("click", "error")
    blank = F.lit("")
    return e.select(
        F.concat(F.lit("t"), (user % 2).cast("string")).alias("tenant_id"),
        user.cast("string").alias("session_id"), "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.when(kind == "view", "assistant").when(tool, "tool").when(kind == "signup", "user")
        .otherwise("progress").alias("kind"),
        F.floor("value").cast("long").alias("out_tokens"),
        (k * 3).alias("thinking_tokens"),
        (F.col("value").cast("decimal(12,2)") * F.lit("0.01").cast("decimal(3,2)")).alias("cost_usd"),
        F.when(kind == "view", F.format_string(
            "Step %d of the plan is to try it again and see what happens %d", k % 2, user % 3))
        .otherwise(blank).alias("text"),
        F.when(tool, F.lit("Bash")).otherwise(blank).alias("tool"),
        F.when(tool, (k % 2).cast("string")).otherwise(blank).alias("tool_args"),
        kind.isin("purchase", "signup").alias("progress"),
        F.concat(F.lit("model-"), (user % 4).cast("string")).alias("model_id"),
    )


GUARD_SQL = """
G as (
  select concat('t', user_id % 2) as tenant_id, cast(user_id as varchar) as session_id, event_id,
    epoch_us(ts) / 1e6 as ts, user_id,
    case when event_type = 'view' then 'assistant' when event_type in ('click','error') then 'tool'
      when event_type = 'signup' then 'user' else 'progress' end as kind,
    cast(floor(value) as bigint) as out_tokens,
    cast(json_extract(props, '$.k') as bigint) * 3 as thinking,
    cast(value as decimal(12,2)) * cast(0.01 as decimal(3,2)) as cost,
    concat('Step ', cast(json_extract(props, '$.k') as bigint) % 2,
      ' of the plan is to try it again and see what happens ', user_id % 3) as text,
    case when event_type in ('click','error')
      then concat('Bash|', cast(json_extract(props, '$.k') as bigint) % 2) end as call,
    event_type in ('purchase','signup') as progress
  from events),
GA as (
  select *, sum(case when kind = 'user' then 1 else 0 end) over w as seg,
    sum(cost) over w as spent, sum(out_tokens) over w as tout, sum(thinking) over w as tthink,
    coalesce(max(case when kind = 'user' then ts end) over w, min(ts) over w) as started
  from G window w as (partition by session_id order by ts, event_id rows unbounded preceding)),
GB as (
  select *, max(case when progress and kind <> 'user' then ts end) over (partition by session_id, seg
      order by ts, event_id rows unbounded preceding) as lp,
    list({'s': seg, 't': ts, 'c': case when not progress then call end}) over (
      partition by session_id order by ts, event_id rows between 23 preceding and current row) as calls
  from GA),
GC as (
  select *, list_transform(list_filter(calls, lambda e: e.s = seg and e.t >= coalesce(lp, started)
      and e.c is not null), lambda e: e.c) as mine from GB),
GD as (
  select *, coalesce(list_max(list_transform(list_distinct(mine),
      lambda x: len(list_filter(mine, lambda y: y = x)))), 0) as loops from GC),
GT as (
  select event_id, seg, text, list({'s': seg, 'x': text}) over (partition by session_id
      order by ts, event_id rows between 5 preceding and current row) as l
  from GD where kind = 'assistant'),
GU as (
  select event_id, text, list_transform(list_filter(l, lambda e: e.s = seg), lambda e: e.x) as xs from GT),
GV as (
  select event_id, len(xs) as nt, regexp_extract_all(lower(text), '\\w+') as wb,
    regexp_extract_all(lower(array_to_string(xs[1:len(xs) - 1], ' ')), '\\w+') as wa from GU),
GW as (
  select event_id, nt,
    list_transform(range(1, len(wb) - 1), lambda i: array_to_string(wb[i:i + 2], ' ')) as tb,
    list_transform(range(1, len(wa) - 1), lambda i: array_to_string(wa[i:i + 2], ' ')) as ta from GV),
GX as (
  select event_id, nt, case when nt >= 2 and len(ta) > 0 and len(tb) > 0
    then len(list_filter(tb, lambda t: list_contains(ta, t))) / cast(len(tb) as double) else 0e0 end as r
  from GW),
GS as (
  select GD.*, coalesce(last_value(r ignore nulls) over w, 0e0) as ratio,
    coalesce(last_value(nt ignore nulls) over w, 0) as n_texts
  from GD left join GX using (event_id)
  window w as (partition by session_id, seg order by ts, event_id rows unbounded preceding))"""


def verdict_sql(now: str, source: str = "GS") -> str:
    """The judgement of session states under POLICY and fixed expectations, as of ``now``."""
    return f"""
VA as (select *, greatest(0, {now} - started) as elapsed,
    greatest(0, {now} - coalesce(lp, started)) as quiet, {now} - ts as hush from {source}),
VB as (select *, lp is not null and quiet < 86400 as recent from VA),
VC as (select *, case when hush >= 86400 and not recent then 40 else 0 end
    + case when loops >= 3 then 45 else 0 end
    + case when n_texts >= 2 and ratio >= 0.6e0 then 40 else 0 end as stuck, spent >= 8 as capped,
    case when tout <> 0 and tthink / cast(greatest(1, tout) as double) > 7 then 25 else 0 end
    + case when spent >= 8 then 60 else 0 end + case when spent > 2 * 2.5 then 40 else 0 end
    + case when elapsed > 2e0 * 400000 then 20 else 0 end as burn from VB),
VD as (select *, least(100, greatest(case when recent then least(burn, 55)
    else greatest(stuck, burn) end, case when capped then 90 else 0 end)) as score from VC),
VE as (select *, recent and stuck + burn > 0 as hard,
    case when capped or (burn >= 60 and not recent) then 'burning'
      when stuck >= 40 and not recent then 'stalled' when score >= 25 then 'watch' else 'ok' end
      as state from VD)"""


VERDICT_OUT_SQL = """
  tenant_id, session_id, event_id, state, cast(score as bigint) as score,
  cast(spent as double) as spent_usd, round(elapsed, 3) as elapsed_s,
  round(quiet, 3) as since_progress_s, cast(tout as bigint) as out_tokens,
  cast(tthink as bigint) as thinking_tokens, cast(loops as bigint) as tool_loops,
  round(ratio, 6) as repeat_ratio, hard as working_hard"""


def _verdicts(spark, sf_dir, as_of=None):
    e = guard_events(spark, sf_dir)
    expected = e.select("model_id").distinct().select(
        "model_id", F.lit(2.5).alias("expected_cost_usd"), F.lit(400000.0).alias("expected_seconds"))
    return guard.stall_verdicts(e, POLICY, expected, as_of=as_of)


def _verdict_columns(v):
    return v.select(
        "tenant_id", "session_id", "event_id", "state", cnt("score", "score"),
        F.col("spent_usd").cast("double").alias("spent_usd"), num("elapsed_s", "elapsed_s", 3),
        num("since_progress_s", "since_progress_s", 3), "out_tokens", "thinking_tokens",
        cnt("tool_loops", "tool_loops"), num("repeat_ratio", "repeat_ratio"), "working_hard")


@query("W12_stall_verdicts", f"with {GUARD_SQL}, {verdict_sql('ts')} select {VERDICT_OUT_SQL} from VE")
def w12(spark, sf_dir):
    return _verdict_columns(_verdicts(spark, sf_dir))


AS_OF = 1706000000.0


@query("W12_stall_verdicts_as_of", f"""
with {GUARD_SQL},
GL as (select * from (select *, row_number() over (partition by session_id
         order by ts desc, event_id desc) as back from GS where ts <= {AS_OF}) where back = 1),
{verdict_sql(str(AS_OF) + 'e0', 'GL')} select {VERDICT_OUT_SQL} from VE""")
def w12_as_of(spark, sf_dir):
    return _verdict_columns(_verdicts(spark, sf_dir, AS_OF))


@query("W13_state_changes", f"""
with {GUARD_SQL}, {verdict_sql('ts')},
C as (select *, lag(state, 1, 'ok') over (partition by session_id order by ts, event_id) as was from VE)
select session_id, event_id, state,
  case when state in ('stalled', 'burning') then state else 'warn' end as level
from C where was <> state and (state in ('stalled', 'burning') or (state = 'watch' and hard))""")
def w13(spark, sf_dir):
    return guard.state_changes(_verdicts(spark, sf_dir)).select(
        "session_id", "event_id", "state", "level")


@query("A42_spend_totals", f"""
with {GUARD_SQL},
S as (select tenant_id, cast(to_timestamp(ts) at time zone 'UTC' as date) as day, session_id,
        sum(cost) as c from G group by all)
select tenant_id, cast(day as varchar) as day, cast(sum(c) as double) as spent_usd,
  count(*) as n_sessions, cast(max(c) as double) as max_session_usd from S group by tenant_id, day""")
def a42(spark, sf_dir):
    t = guard.spend_totals(guard_events(spark, sf_dir))
    return t.select("tenant_id", F.col("day").cast("string").alias("day"),
                    F.col("spent_usd").cast("double").alias("spent_usd"), "n_sessions",
                    F.col("max_session_usd").cast("double").alias("max_session_usd"))


@query("A42_worst_state", f"""
with {GUARD_SQL}, {verdict_sql('ts')},
L as (select tenant_id, session_id, arg_max(state, (ts, event_id)) as s from VE group by all)
select tenant_id, ['ok','watch','stalled','burning'][max(list_position(
  ['ok','watch','stalled','burning'], s))] as state, count(*) as n_sessions from L group by tenant_id""")
def a42_worst(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return guard.worst_state(v)


@query("T5_metered_caps", f"""
with {GUARD_SQL},
M as (select event_id, cost,
    sum(cost) over (partition by session_id order by ts, event_id rows unbounded preceding) as s,
    sum(cost) over (partition by tenant_id, cast(to_timestamp(ts) at time zone 'UTC' as date)
      order by ts, event_id rows unbounded preceding) as d from G)
select event_id, cast(s as double) as session_after, cast(d as double) as day_after,
  case when s - cost >= 2 then 'session budget' when d - cost >= 5 then 'daily budget' else '' end
    as cap_before,
  case when s >= 2 then 'session budget' when d >= 5 then 'daily budget' else '' end as cap_after
from M""")
def t5(spark, sf_dir):
    m = guard.metered_caps(guard_events(spark, sf_dir),
                           {"session_budget_usd": 2.0, "daily_budget_usd": 5.0})
    return m.select("event_id", F.col("session_after").cast("double").alias("session_after"),
                    F.col("day_after").cast("double").alias("day_after"), "cap_before", "cap_after")


@query("J11_effective_policy", """
select cast(s_suppkey as varchar) as tenant_id,
  case when s_suppkey % 5 = 0 then 7e0 when s_suppkey % 3 = 0 then 60e0
    when s_suppkey % 2 = 0 then 90e0 else 120e0 end as silence_s,
  case when s_suppkey % 5 = 0 then 3 when s_suppkey % 2 = 0 and not (s_suppkey % 3 = 0 and
    s_suppkey % 4 = 0) then s_suppkey % 7 else 3 end as max_repeat,
  case when s_suppkey % 5 = 0 then 'explicit' when s_suppkey % 2 = 0 and s_suppkey % 3 = 0
    then 'machine+user' when s_suppkey % 3 = 0 then 'machine' else 'user' end as source
from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0 or s_suppkey % 5 = 0""")
def j11(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").withColumn(
        "tenant_id", F.col("s_suppkey").cast("string"))
    n = F.col("s_suppkey")
    user = s.filter(n % 2 == 0).select("tenant_id", F.lit(90.0).alias("silence_s"),
                                       (n % 7).alias("max_repeat"))
    machine = s.filter(n % 3 == 0).select(
        "tenant_id", F.lit(60.0).alias("silence_s"),
        F.when(n % 4 == 0, F.array(F.lit("max_repeat"))).alias("locked"))
    explicit = s.filter(n % 5 == 0).select("tenant_id", F.lit(7.0).alias("silence_s"))
    return guard.effective_policy(user, machine, explicit).select(
        "tenant_id", "silence_s", cnt("max_repeat", "max_repeat"), "source")


# ---------------------------------------------------------------------- cage
def _sql_text(s: str) -> str:
    return s.replace("'", "''")


def redact_sql(t: str) -> str:
    return (f"case when len({t}) > 4 then concat({t}[1:4], '…', repeat('*', "
            f"least(8, len({t}) - 4))) else '****' end")


_SECRET_SQL = " union all ".join(
    f"select doc_id, '{label}' as what, unnest(regexp_extract_all(text, "
    f"'{_sql_text(pattern.replace('(?iU)', '(?i)').replace('(?U)', ''))}', 1)) as t from documents"
    for label, pattern in guard.SECRETS
)


@query("P15_find_secrets", f"""
with S as ({_SECRET_SQL}) select doc_id, what, {redact_sql('t')} as snippet from S""")
def p15(spark, sf_dir):
    return guard.find_secrets(ad.table(spark, sf_dir, "documents")).select(
        "doc_id", "what", "snippet")


def _orders(spark, sf_dir):
    return ad.table(spark, sf_dir, "orders")


@query("P16_find_paths", """
with O as (select o_orderkey, o_custkey % 5 as u, o_orderkey % 3 as p from orders)
select o_orderkey, concat('/home/u', u, '/x', o_orderkey, '.txt') as snippet from O where u <> 2
union all select o_orderkey, concat('/opt/p', p, '/A/b') from O where p <> 1
union all select o_orderkey, concat('D:\\data\\', o_orderkey) from O""")
def p16(spark, sf_dir):
    text = F.format_string(
        "run cat /home/u%d/x%d.txt, then ls /opt/p%d/A/b. and D:\\data\\%d or ./var/x /tmp/q",
        F.col("o_custkey") % 5, F.col("o_orderkey"), F.col("o_orderkey") % 3, F.col("o_orderkey"))
    d = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))
    return guard.find_paths(d, ["/opt/P1", "/home/u2/"], key=["o_orderkey"]).select(
        "o_orderkey", "snippet")


@query("P17_find_network", """
with O as (select o_orderkey, o_custkey % 4 as h, concat('x', o_orderkey % 2) as q,
    concat(case when o_orderkey % 2 = 0 then 'curl' else 'Curl' end, ' https://api.h', o_custkey % 4,
      '.example.com/x?k=', o_orderkey, ' and http://me@h1.org:80/ or http://localhost:3 ok') as text
  from orders)
select o_orderkey, concat('outbound command: ', text[1:4]) as what, trim(text[1:60]) as snippet from O
union all select o_orderkey, concat('outbound host: api.h', h, '.example.com'),
  concat('api.h', h, '.example.com') from O where h <> 2""")
def p17(spark, sf_dir):
    n = F.col("o_orderkey")
    text = F.concat(F.when(n % 2 == 0, "curl").otherwise("Curl"), F.format_string(
        " https://api.h%d.example.com/x?k=%d and http://me@h1.org:80/ or http://localhost:3 ok",
        F.col("o_custkey") % 4, n))
    d = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))
    return guard.find_network(d, ["h1.org", "h2.example.com"], key=["o_orderkey"]).select(
        "o_orderkey", "what", "snippet")


@query("P18_find_env_reads", """
select o_orderkey, case o_orderkey % 4 when 0 then 'PrintEnv' when 1 then 'cat ~/.ssh/'
  when 2 then '.env' end as snippet from orders where o_orderkey % 4 <> 3""")
def p18(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, "run PrintEnv now").when(m == 1, "cat ~/.ssh/id").when(
        m == 2, "see .env file").otherwise("set x, environment")
    d = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))
    return guard.find_env_reads(d, key=["o_orderkey"]).select("o_orderkey", "snippet")


@query("P19_find_bypass", """
with O as (select o_orderkey, concat('AKIA', lpad(cast(o_orderkey as varchar), 16, 'Q')) as k from orders)
select o_orderkey, 'base64-encoded AWS access key' as what, concat('AKIA…', repeat('*', 8)) as snippet
from O where o_orderkey % 3 = 0
union all select o_orderkey, 'secret split into pieces', concat('sk" …', repeat('*', 6)) from O
  where o_orderkey % 3 = 1
union all select o_orderkey, 'talks about evading the guard', concat('bypass step ', o_orderkey, ' of the guard')
  from O where o_orderkey % 3 = 2""")
def p19(spark, sf_dir):
    n = F.col("o_orderkey")
    secret = F.concat(F.lit("key AKIA"), F.lpad(n.cast("string"), 16, "Q"), F.lit(" end."))
    text = F.when(n % 3 == 0, F.concat(
        F.lit("send "), F.rtrim(F.base64(F.encode(secret, "UTF-8")), F.lit("=")), F.lit(" on"))
    ).when(n % 3 == 1, F.lit('use "sk" + "antelope7"')).otherwise(
        F.format_string("now bypass step %d of the guard", n))
    d = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))
    return guard.find_bypass(d, key=["o_orderkey"]).select("o_orderkey", "what", "snippet")


@query("P20_inspect_outbound", """
with O as (select o_orderkey, o_custkey % 2 = 0 as strict from orders)
select o_orderkey, case when o_orderkey % 2 = 0 or strict then 'block' else 'warn' end as decision,
  cast(3 + case when o_orderkey % 2 = 0 then 1 else 0 end as bigint) as n_findings
from O where o_orderkey % 5 <> 0""")
def p20(spark, sf_dir):
    n = F.col("o_orderkey")
    text = F.concat(
        F.lit("wget http://x.example.com/a; wget http://x.example.com/a"),
        F.when(n % 2 == 0, F.lit(" token = 'abcdefghijklmnop1234'; token='abcdefghijklmnop1234'"))
        .otherwise(""))
    d = _orders(spark, sf_dir).select(
        "o_orderkey", F.when(n % 5 == 0, "").otherwise(text).alias("text"),
        F.when(F.col("o_custkey") % 2 == 0, "block").otherwise("warn").alias("cage_action"))
    found = guard.inspect_outbound(
        d, {"cage_action": F.col("cage_action")}, key=["o_orderkey"])
    return guard.decisions(found, key=["o_orderkey"])


@query("P20_inspect_documents", f"""
with S as ({_SECRET_SQL}), D as (select distinct doc_id, {redact_sql('t')} as snippet from S)
select doc_id, snippet from D""")
def p20_documents(spark, sf_dir):
    found = guard.inspect_outbound(ad.table(spark, sf_dir, "documents"))
    return found.filter("kind = 'secret'").select("doc_id", "snippet")


@query("P20_inspect_kinds", f"""
with S as ({_SECRET_SQL})
select distinct doc_id, 'secret' as kind, {redact_sql('t')} as snippet from S
union all select doc_id, (['outside_workspace', 'network', 'env_dump', 'bypass'])[doc_id % 5 + 1], (['/etc/p' || doc_id % 3,
  'curl https://h' || doc_id % 4 || '.example.com/x', 'PrintEnv', 'bypass the guard'])[doc_id % 5 + 1] from documents where doc_id % 5 < 4
union all select doc_id, 'network', 'h' || doc_id % 4 || '.example.com' from documents where doc_id % 5 = 1""")
def p20_kinds(spark, sf_dir):
    """Every document with a piece of one of the other kinds behind it."""
    d, n = ad.table(spark, sf_dir, "documents"), F.col("doc_id")
    piece = (F.when(n % 5 == 0, F.format_string("see /etc/p%d", n % 3))
             .when(n % 5 == 1, F.format_string("curl https://h%d.example.com/x", n % 4))
             .when(n % 5 == 2, F.lit("PrintEnv")).when(n % 5 == 3, F.lit("now bypass the guard")).otherwise(""))
    return guard.inspect_outbound(d.select("doc_id", F.concat_ws("\n;\n", "text", piece).alias("text"))).select(
        "doc_id", "kind", "snippet")


@query("F2_trigram_overlap", r"""
with P as (select conv_id, turn, lower(text) as b,
    lower(lag(text) over (partition by conv_id order by turn)) as a from conversations),
W as (select conv_id, turn, regexp_extract_all(a, '[\p{L}\p{N}_]+') as wa,
    regexp_extract_all(b, '[\p{L}\p{N}_]+') as wb from P where a is not null),
T as (select conv_id, turn,
    list_transform(range(1, len(wa) - 1), lambda i: array_to_string(wa[i:i + 2], ' ')) as ta,
    list_transform(range(1, len(wb) - 1), lambda i: array_to_string(wb[i:i + 2], ' ')) as tb from W)
select conv_id, turn, case when len(ta) > 0 and len(tb) > 0 then round(len(list_filter(tb,
    lambda t: list_contains(ta, t))) / cast(len(tb) as double), 6) else 0e0 end as overlap from T""")
def f2(spark, sf_dir):
    from winledger.plans.ordered import scan

    c = ad.table(spark, sf_dir, "conversations")
    p = scan(c, ["conv_id"], ["turn"], lag={"prev": F.col("text")}).filter("prev is not null")
    return p.select("conv_id", "turn", num(trigram_overlap(F.col("prev"), F.col("text")), "overlap"))
