"""Conversations: normalising, summaries, prompt compaction and every source layout.

Source texts are written from the conversations table, one file per conversation."""

from pyspark.sql import functions as F

from winledger.operators import conversations as conv
from winledger.plans import adapters as ad
from winledger.queries import cnt, query
from winledger.sources import chats

CAP = 3000


def _turns(spark, sf_dir):
    return ad.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))


def normal_sql(source: str, cap: int) -> str:
    """Normalised turns of a table (conv_id, turn, role, content)."""
    return f"""
n0 as (select conv_id, turn, case when lower(role) in ('assistant','model','ai','claude','chatgpt','gpt','bot')
    then 'assistant' else 'user' end as role, trim(content, E' \\n\\t\\r') as content from {source}),
n1 as (select *, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as o
       from n0 where content <> ''),
n2 as (select *, sum(o) over (partition by conv_id order by turn rows unbounded preceding) as run from n1),
n3 as (select conv_id, run, any_value(role) as role, string_agg(content, E'\\n\\n' order by turn) as content
       from n2 group by all),
n4 as (select *, row_number() over (partition by conv_id order by run) as rn,
    row_number() over (partition by conv_id order by run desc) as back from n3),
n5 as (select * from n4 where not (rn = 1 and role = 'assistant') and not (back = 1 and role = 'user')),
n6 as (select *, row_number() over (partition by conv_id order by run) - 1 as pos,
    count(*) over (partition by conv_id) as size from n5),
n7 as (select conv_id, pos // 2 as pair, sum(len(content)) as l, any_value(size) // 2 as pairs from n6 group by all),
n8 as (select *, sum(l) over (partition by conv_id order by pair desc rows unbounded preceding) as suffix from n7),
n9 as (select conv_id, min(pair) as dropped from n8 where suffix <= {cap} or pair = pairs - 1 group by conv_id),
nz as (select n6.conv_id, pos - 2 * dropped as turn, role, concat(
    case when pos = 2 * dropped and dropped > 0 then concat('[imported — ', dropped,
      ' earlier exchange(s) omitted to fit the prompt budget]', E'\\n\\n') else '' end,
    case when pos = 2 * dropped and len(content) > {cap} then right(content, {cap}) else content end) as content
  from n6 join n9 using (conv_id) where pos >= 2 * dropped)"""


PLAIN_SQL = "C0 as (select conv_id, turn, role, text as content from conversations)"


@query("W14_normalise_turns", f"""
with {PLAIN_SQL}, {normal_sql('C0', CAP)}
select conv_id, turn, role, len(content) as chars, md5(content) as digest from nz""")
def w14(spark, sf_dir):
    out = conv.normalise_turns(_turns(spark, sf_dir), max_chars=CAP)
    return out.select("conv_id", cnt("turn", "turn"), "role",
                      cnt(F.length("content"), "chars"), F.md5("content").alias("digest"))


@query("W15_summarise_conversations", f"""
with {PLAIN_SQL}, {normal_sql('C0', 120000)}
select conv_id, count(*) // 2 as turns, cast(sum(len(content)) as bigint) as chars,
  cast(sum(len(content)) // 4 as bigint) as est_tokens from nz group by conv_id""")
def w15(spark, sf_dir):
    return conv.summarise_conversations(conv.normalise_turns(_turns(spark, sf_dir)))


@query("P24_compact_prompts", f"""
with D as (select doc_id, concat('Please can you extract ', case when doc_id % 2 = 0 then 'json ' else '' end,
    'really ', trim(text, E' \\n\\t\\r'), ', thanks.') as intent, case doc_id % 3 when 0 then 'Claude-x'
    when 1 then 'gpt-4' else 'other' end as m from documents),
K as (select doc_id, intent, m, trim(trim(regexp_replace(regexp_replace(intent,
    '{conv.FILLER.replace("(?iU)", "")}', '', 'gi'), '\\s+', ' ', 'g'), E' .,\\t\\n')) as core from D),
S as (select doc_id, len(concat('{conv.NAIVE_PREAMBLE}', intent, '{conv.NAIVE_SUFFIX}')) as ln,
    len(concat('Return ONLY valid JSON, no prose. Style: ', case m
      when 'Claude-x' then '{conv.CONVENTIONS[0][1]}' when 'gpt-4' then '{conv.CONVENTIONS[1][1]}'
      else '{conv.DEFAULT_CONVENTION}' end, '. ', rtrim(core, '.'), '.')) as lo from K),
T as (select doc_id, cast(greatest(1, round_even(ln / 4e0, 0)) as bigint) as naive_tokens,
    cast(greatest(1, round_even(lo / 4e0, 0)) as bigint) as optimized_tokens from S)
select *, greatest(0, naive_tokens - optimized_tokens) as saved_tokens,
  cast(round_even(greatest(0, naive_tokens - optimized_tokens) / cast(naive_tokens as double) * 100, 0) as bigint)
    as saved_pct from T""")
def p24(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    intent = F.concat(
        F.lit("Please can you extract "), F.when(F.col("doc_id") % 2 == 0, "json ").otherwise(""),
        F.lit("really "), F.expr(r"trim(both ' \n\t\r' from text)"), F.lit(", thanks."))
    m = F.col("doc_id") % 3
    model = F.when(m == 0, "Claude-x").when(m == 1, "gpt-4").otherwise("other")
    return conv.compact_prompts(d.select(
        "doc_id", intent.alias("intent"), model.alias("target_model"))).select(
        "doc_id", "naive_tokens", "optimized_tokens", "saved_tokens", "saved_pct")


# ------------------------------------------------------------- written sources
def _files(spark, sf_dir, line, wrap, ext):
    """One text per conversation: a record per turn, in order, put together by ``wrap``."""
    t = ad.table(spark, sf_dir, "conversations")
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", line.alias("x")))).alias("_l"))
    texts = F.transform("_l", lambda e: e["x"])
    return per.select(
        F.concat(F.lit("/chats/"), F.col("conv_id").cast("string"), F.lit(ext)).alias("path"),
        wrap(texts).alias("text"), "conv_id")


def _digest(turns):
    """Normalised turns by conversation number."""
    number = F.regexp_extract("conv_id", r"/chats/(\d+)", 1).cast("long")
    out = conv.normalise_turns(turns.select("conv_id", "turn", "role", "content"), max_chars=CAP)
    return out.select(number.alias("conv_id"), cnt("turn", "turn"), "role",
                      cnt(F.length("content"), "chars"), F.md5("content").alias("digest"))


def _digest_sql(role: str = "role", content: str = "text") -> str:
    return f"""
with C0 as (select conv_id, turn, {role} as role, {content} as content from conversations),
{normal_sql('C0', CAP)}
select conv_id, turn, role, len(content) as chars, md5(content) as digest from nz"""


def _log_files(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),))
    listed = F.concat(
        F.lit('{"type":"'), kind, F.lit('","timestamp":"2024-05-06T01:02:03Z","cwd":"/w/proj","message":{"content":'),
        F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text"))).otherwise(blocks), F.lit("}}"))
    plain = F.regexp_replace(listed, r'"content":\{"text":(.*)\}\}\}$', r'"content":$1}}')
    skipped = F.lit('{"type":"user","isMeta":true,"message":{"content":"meta"}}\nnot json\n{"x":1}')
    return _files(spark, sf_dir, plain, lambda xs: F.concat(
        F.lit('{"type":"summary","summary":"A title"}\n'), skipped, F.lit("\n"),
        F.array_join(xs, "\n")), ".jsonl")


@query("S9_session_logs", _digest_sql("case when role = 'assistant' then role else 'user' end"))
def s9(spark, sf_dir):
    turns, _ = chats.parse_session_logs(_log_files(spark, sf_dir).select("path", "text"))
    return _digest(turns)


@query("S9_session_titles", """
select distinct conv_id, 'A title' as title, 'proj' as project, '2024-05-06' as "when" from conversations""")
def s9_titles(spark, sf_dir):
    _, c = chats.parse_session_logs(_log_files(spark, sf_dir).select("path", "text"))
    return c.select(F.regexp_extract("conv_id", r"/chats/(\d+)", 1).cast("long").alias("conv_id"),
                    "title", "project", "when")


def _export_a(spark, sf_dir):
    m = F.to_json(F.struct(
        F.when(F.col("role") == "assistant", "Assistant").otherwise("human").alias("sender"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"),
        F.when(F.col("turn") % 2 == 1, F.array(F.struct(
            F.lit("text").alias("type"), F.col("text").alias("text")))).alias("content")))
    return _files(spark, sf_dir, m, lambda xs: F.concat(
        F.lit('[{"name":"n","created_at":"2024-02-03T00:00:00Z","chat_messages":['),
        F.array_join(xs, ","), F.lit("]}]")), ".json")


@query("S10_chat_export_a", _digest_sql("case when role = 'assistant' then role else 'user' end"))
def s10(spark, sf_dir):
    return _digest(chats.parse_chat_export_a(_export_a(spark, sf_dir).select("path", "text")))


def _export_b(spark, sf_dir):
    t = F.col("turn")
    node = F.concat(
        F.lit('"n'), t.cast("string"), F.lit('":{"parent":'),
        F.when(t == 0, F.lit('"root"')).otherwise(F.concat(F.lit('"n'), (t - 1).cast("string"), F.lit('"'))),
        F.lit(',"children":[],"message":{"author":{"role":"'), F.col("role"),
        F.lit('"},"content":'),
        F.to_json(F.struct(F.array(F.col("text"), F.lit("tail")).alias("parts"))), F.lit("}}"))
    return _files(spark, sf_dir, node, lambda xs: F.concat(
        F.lit('{"title":"t","create_time":1700000000.5,"current_node":"n'),
        (F.size(xs) - 1).cast("string"),
        F.lit('","mapping":{"root":{"parent":null,"children":["n0"]},"stray":{"parent":"n0","children":[],'
              '"message":{"author":{"role":"user"},"content":{"parts":["edited away"]}}},'),
        F.array_join(xs, ","), F.lit("}}")), ".json")


@query("S11_chat_export_b", f"""
with C0 as (select conv_id, turn, role, concat(text, E'\\ntail') as content from conversations
            where role in ('user', 'assistant')), {normal_sql('C0', CAP)}
select conv_id, turn, role, len(content) as chars, md5(content) as digest from nz""")
def s11(spark, sf_dir):
    return _digest(chats.parse_chat_export_b(_export_b(spark, sf_dir).select("path", "text")))


def _transcripts(spark, sf_dir):
    head = F.when(F.col("role") == "assistant", "**Claude**: ").otherwise("> Me： ")
    flat = F.regexp_replace(F.col("text"), ":", ";")
    return _files(spark, sf_dir, F.concat(head, flat), lambda xs: F.concat(
        F.lit("preface\n"), F.array_join(xs, "\n")), ".md")


@query("S12_transcripts", _digest_sql(
    "case when role = 'assistant' then role else 'user' end", "replace(text, ':', ';')"))
def s12(spark, sf_dir):
    return _digest(chats.parse_transcripts(_transcripts(spark, sf_dir).select("path", "text")))


def _messages(spark, sf_dir):
    m = F.to_json(F.struct("role", F.col("text").alias("content")))
    return _files(spark, sf_dir, m, lambda xs: F.concat(
        F.lit('{"messages":['), F.array_join(xs, ","), F.lit("]}")), ".json")


def _mixed(spark, sf_dir):
    """Each conversation in one of the five layouts."""
    makers = (_log_files, _export_a, _export_b, _transcripts, _messages)
    out = None
    for i, make in enumerate(makers):
        part = make(spark, sf_dir).filter(F.col("conv_id") % 5 == i).select("path", "text")
        out = part if out is None else out.unionByName(part)
    return out


@query("S13_detect_format", """
select distinct conv_id, (['session_log','export_a','export_b','transcript','messages'])[conv_id % 5 + 1] as format
from conversations""")
def s13(spark, sf_dir):
    return chats.detect_format(_mixed(spark, sf_dir)).select(
        F.regexp_extract("path", r"/chats/(\d+)", 1).cast("long").alias("conv_id"), "format")


@query("S13_parse_any", f"""
with C0 as (select conv_id, turn, role, case conv_id % 5 when 2 then concat(text, E'\\ntail')
      when 3 then replace(text, ':', ';') else text end as content from conversations
    where conv_id % 5 <> 2 or role in ('user', 'assistant')), {normal_sql('C0', CAP)}
select conv_id, turn, role, len(content) as chars, md5(content) as digest from nz""")
def s13_parse(spark, sf_dir):
    return _digest(chats.parse_any(_mixed(spark, sf_dir)))


@query("S13_conversations", """
with F as (select conv_id, left(trim(arg_min(text, turn), E' \\t\\n'), 80) as opening from conversations
  where trim(text, E' \\t\\n') <> '' group by conv_id)
select conv_id, case conv_id % 5 when 0 then 'A title' when 1 then 'n' when 2 then 't' when 3 then cast(conv_id as varchar)
    else opening end as title, case conv_id % 5 when 0 then 'proj' else '' end as project,
  case conv_id % 5 when 0 then '2024-05-06' when 1 then '2024-02-03' when 2 then '2023-11-14' else '' end as "when"
from F""")
def s13_conversations(spark, sf_dir):
    c = chats.conversations(_mixed(spark, sf_dir))
    return c.select(F.regexp_extract("conv_id", r"/chats/(\d+)", 1).cast("long").alias("conv_id"), "title", "project", "when")
