"""Conversation sources: session logs, two chat-export layouts, transcripts, plain messages.

Readers take files: logs and transcripts by line, in blocks, exports whole. Parsers take a table (path, text) with one
whole file per row, or (path, line, raw). All give turns (conv_id, turn, role, content), before normalisation, with
title and day where the source has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winledger.functions.jsontext import spaced_json
from winledger.functions.text import LINE_BREAK, strip_blank
from winledger.operators.conversations import role_of
from winledger.plans.ordered import Ordered, held, scan
from winledger.sources import events

MAX_TOOL_CHARS = 400
# Blocks a harness puts into a user's turn.
HARNESS_TAGS = (
    r"(?s)<(system-reminder|local-command-caveat|task-notification|command-name|command-message"
    r"|command-args|local-command-stdout|ci-monitor-event)>.*?</\1>"
)
# Fixed value: a line that opens a speaker's part.
SPEAKER = (
    r"(?iU)^\s*(?:\*\*|#+\s*|>\s*)?(user|you|human|me|assistant|ai|claude|chatgpt|gpt|bot|model)"
    r"(?:\*\*)?\s*[:：]\s*"
)
# How a text without speakers is introduced and answered.
MATERIAL_INTRO = "Here is the material I was working on:\n\n"
MATERIAL_REPLY = "Got it — I have the material. What next?"

BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("content", T.StringType()),
])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file; files are the unit of parallelism."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _listed(raw: Column) -> Column:
    """A JSON array text as its elements' texts, NULL for anything else."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))


def _plain_text(raw: Column) -> Column:
    """Readable text of a simple content value: a string, or a list of strings and text blocks."""
    def piece(e: Column) -> Column:
        return F.when(F.ltrim(e).startswith("{"), F.get_json_object(e, "$.text")).otherwise(e)

    parts = F.transform(_listed(raw), piece)
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    single = F.when(F.ltrim(raw).startswith("{"), F.get_json_object(raw, "$.text")).otherwise(raw)
    return F.coalesce(F.array_join(kept, "\n"), single)


def _block_texts(df: DataFrame, raw: str, into: str, key: list[str]) -> DataFrame:
    """Add the readable text of a message content column (a string or a JSON list of blocks): tool
    calls and results in one line, private reasoning left out."""
    pieces = df.select(*key, F.posexplode(_listed(F.col(raw))).alias("_i", "_e")).withColumn(
        "_b", F.when(F.ltrim(F.col("_e")).startswith("{"), F.from_json("_e", BLOCK)))
    b = F.col("_b")
    shown = F.substring(spaced_json(F.coalesce(b["input"], F.lit("{}"))), 1, MAX_TOOL_CHARS)
    result = _plain_text(b["content"])
    text = (
        F.when(b.isNull(), F.col("_e"))
        .when(b["type"] == "tool_use", F.concat(
            F.lit("[used "), F.coalesce(b["name"], F.lit("tool")), F.lit(": "), shown, F.lit("]")))
        .when(b["type"] == "tool_result", F.when(
            result != "",
            F.concat(F.lit("[tool result: "), F.substring(result, 1, MAX_TOOL_CHARS), F.lit("]"))))
        .when(b["type"] == "thinking", F.lit(None))
        .otherwise(b["text"])
    )
    joined = pieces.withColumn("_t", text).filter(F.coalesce("_t", F.lit("")) != "").groupBy(
        *key).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda p: p["_t"]), "\n").alias("_x"))
    plain = F.when(_listed(F.col(raw)).isNull(), F.col(raw))
    return df.join(joined, key, "left").withColumn(
        into, F.coalesce("_x", plain, F.lit(""))).drop("_x")


# -------------------------------------------------------------- session logs
LOG_RECORD = (
    "type string, isSidechain boolean, isMeta boolean, cwd string, timestamp string, "
    "summary string, message struct<content:string>"
)


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, raw) of a table (path, text) with whole files."""
    return files.select("path", F.posexplode(F.split("text", LINE_BREAK)).alias("line", "raw")).withColumn(
        "line", F.col("line").cast("long"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of text files, read in blocks: a large file is cut, and a line knows its number in the file."""
    at = r"(?s)^(.*)#(\d+)$"
    return events.read_lines(spark, path).select(
        F.regexp_extract("_place", at, 1).alias("path"), F.regexp_extract("_place", at, 2).cast("long").alias("line"),
        F.col("value").alias("raw"))


def log_records(lines: DataFrame) -> DataFrame:
    """One row per readable JSON line of session logs (path, line, raw)."""
    return (
        lines.filter(strip_blank(F.col("raw")).startswith("{"))
        .withColumn("r", F.from_json("raw", LOG_RECORD)).filter(F.col("r.type").isNotNull())
    )


def parse_session_logs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of session logs given as whole files (path, text)."""
    return parse_session_lines(file_lines(files))


def parse_session_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of session logs given by line (path, line, raw); conv_id is the path. Subagent and harness
    records are skipped and tool results are folded into the assistant's turn.

    What a line needs of those before it comes from the ordered scan, which cuts a long file into slices."""
    records = log_records(lines)
    talk = records.filter(
        F.col("r.type").isin("user", "assistant")
        & ~F.coalesce("r.isSidechain", F.lit(False)) & ~F.coalesce("r.isMeta", F.lit(False)))
    talk = talk.select("path", "line", F.col("r.type").alias("kind"), "r.cwd", "r.timestamp",
                       F.col("r.message.content").alias("_raw"))
    said = _block_texts(talk, "_raw", "_said", ["path", "line"]).drop("_raw")
    said = said.withColumn(
        "_said", strip_blank(F.regexp_replace("_said", HARNESS_TAGS, ""))).filter("_said <> ''")
    result = (F.col("kind") == "user") & F.col("_said").startswith("[tool result:")
    ordered = Ordered(said.withColumn("_result", result), ["path"], ["line"])
    ordered.add(carry={"_speaker": F.when(~F.col("_result"), F.col("kind"))})
    folded = F.col("_result") & F.coalesce(F.col("_speaker") == "assistant", F.lit(False))
    ordered.map(lambda df: df.withColumn("_folded", folded)).add(running_sum={"_turn": (~F.col("_folded")).cast("int")})
    grouped = ordered.result()
    turns = grouped.groupBy(F.col("path").alias("conv_id"), F.col("_turn").alias("turn")).agg(
        F.min_by("kind", "line").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_said"))),
                                 lambda p: p["_said"]), "\n").alias("content"))

    summary = F.when(F.col("r.type") == "summary", F.nullif(F.col("r.summary"), F.lit("")))
    titles = records.groupBy("path").agg(
        F.substring(F.min_by(summary, F.when(summary.isNotNull(), F.col("line"))), 1, 120)
        .alias("_title"))
    own = ~F.col("_folded")

    def first_of(value: Column) -> Column:
        return F.min_by(value, F.when(own & (F.coalesce(value, F.lit("")) != ""), F.col("line")))

    heads = grouped.groupBy("path").agg(
        F.min_by("_said", F.when(own & (F.col("kind") == "user"), F.col("line"))).alias("_first"),
        first_of(F.col("cwd")).alias("cwd"),
        first_of(F.col("timestamp")).alias("_when"),
    )
    stem = _stem(F.col("path"))
    opening = F.substring(F.split("_first", LINE_BREAK)[0], 1, 80)
    fallback = F.coalesce(F.nullif(F.substring(stem, 1, 12), F.lit("")), F.lit("session"))
    folder = F.regexp_replace(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1), "-", "/")
    conversations = heads.join(titles, "path", "left").select(
        F.col("path").alias("conv_id"), F.coalesce("_title", opening, fallback).alias("title"),
        F.coalesce(F.regexp_extract(F.rtrim(F.col("cwd"), F.lit("/\\")), r"([^/\\]+)$", 1),
                   F.substring(folder, 1, 40)).alias("project"),
        F.coalesce(F.substring("_when", 1, 10), F.lit("")).alias("when"), "cwd",
    )
    return turns, conversations


def read_session_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_session_lines(read_lines(spark, path))


# -------------------------------------------------------------- chat exports
EXPORT_A = (
    "uuid:string,name:string,created_at:string,"
    "chat_messages:array<struct<sender:string,text:string,content:string>>"
)
EXPORT_B = (
    "title:string,create_time:string,current_node:string,mapping:map<string,struct<"
    "message:struct<author:struct<role:string>,content:string>,parent:string,"
    "children:array<string>>>"
)


def _conversations_of(files: DataFrame, layout: str) -> DataFrame:
    """The conversations of export files holding one object or a list of them."""
    whole = F.coalesce(
        F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<struct<{layout}>>")),
        F.array(F.from_json("text", f"struct<{layout}>")),
    )
    rows = files.select("path", F.posexplode(whole).alias("_i", "c"))
    return rows.withColumn("conv_id", F.concat_ws("#", "path", "_i"))


def epoch_day(c: Column) -> Column:
    """Epoch seconds as a UTC day, '' when it is not a number."""
    seconds = c.try_cast("double")
    day = F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("long")), "yyyy-MM-dd")
    return F.coalesce(F.when(F.abs(seconds) < 1e11, day), F.lit(""))


def parse_chat_export_a(files: DataFrame) -> DataFrame:
    """Exports with ``chat_messages`` and ``sender``."""
    convs = _conversations_of(files, EXPORT_A).filter(F.col("c.chat_messages").isNotNull())
    rows = convs.select(
        "conv_id", F.col("c.name").alias("title"), F.substring("c.created_at", 1, 10).alias("when"),
        F.posexplode("c.chat_messages").alias("turn", "m"))
    rows = rows.select("conv_id", "title", "when", "turn", F.col("m.sender").alias("_sender"),
                       F.nullif(F.col("m.text"), F.lit("")).alias("_text"),
                       F.col("m.content").alias("_raw"))
    said = _block_texts(rows, "_raw", "_said", ["conv_id", "turn"])
    return said.select("conv_id", "title", "when", "turn", role_of(F.col("_sender")).alias("role"),
                       F.coalesce("_text", "_said").alias("content"))


def branches(nodes: DataFrame) -> DataFrame:
    """``conv_id``, ``node`` and ``above`` (steps from the current node) of the branch that ends in each tree's current
    node, from nodes (conv_id, node, parent, current).

    Pointers double: every round the nodes found so far, which are those less than 2^k steps above, step 2^k further,
    and each pointer takes the place of two. So a branch is found in as many rounds as its length has binary digits.
    A parent that is no node ends a branch, and so does a node that was passed before: what a cycle would add
    is there already."""
    tree = held(nodes.select("conv_id", "node", "parent", "current"))
    jump = tree.select("conv_id", F.col("node").alias("_from"), F.col("parent").alias("_to")).join(
        tree.select("conv_id", F.col("node").alias("_to")), ["conv_id", "_to"])
    path = held(tree.filter("node = current").select("conv_id", "node", F.lit(0).cast("long").alias("above")))
    size, step = path.count(), 1
    while True:
        jump = held(jump)
        further = path.join(jump, (path["conv_id"] == jump["conv_id"]) & (F.col("node") == F.col("_from"))).select(
            path["conv_id"], F.col("_to").alias("node"), (F.col("above") + step).alias("above"))
        path = held(path.unionByName(further).groupBy("conv_id", "node").agg(F.min("above").alias("above")))
        grown = path.count()
        if grown == size:
            return path
        size, step = grown, 2 * step
        jump = jump.select("conv_id", "_from", F.col("_to").alias("_over")).join(
            jump.select("conv_id", F.col("_from").alias("_over"), "_to"), ["conv_id", "_over"]).drop("_over")


def parse_chat_export_b(files: DataFrame) -> DataFrame:
    """Exports with a ``mapping`` tree: the branch that ends in the current node."""
    convs = _conversations_of(files, EXPORT_B).filter(F.col("c.mapping").isNotNull())
    tree = F.col("c.mapping")
    leaves = F.filter(F.map_entries(tree), lambda e: F.coalesce(F.size(e["value"]["children"]), F.lit(0)) <= 0)
    leaf = F.try_element_at(leaves, F.lit(-1))["key"]
    current = F.coalesce(F.nullif(F.col("c.current_node"), F.lit("")), leaf)
    nodes = convs.select(
        "conv_id", F.col("c.title").alias("title"), epoch_day(F.col("c.create_time")).alias("when"), current.alias("current"),
        F.explode(tree).alias("node", "e")).select("*", F.col("e.parent").alias("parent"), F.col("e.message").alias("m")).drop("e")
    path = branches(nodes).select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), "above")
    length = path.groupBy(F.col("_conv").alias("_of")).agg(F.max("above").alias("_last"))
    rows = nodes.join(path, (F.col("conv_id") == F.col("_conv")) & (F.col("node") == F.col("_node"))).join(
        length, F.col("conv_id") == F.col("_of")).withColumn("turn", (F.col("_last") - F.col("above")).cast("int"))
    role, raw = F.col("m.author.role"), F.col("m.content")
    parts = F.from_json(F.get_json_object(raw, "$.parts"), "array<string>")

    def piece(p: Column) -> Column:
        return F.when(F.ltrim(p).startswith("{"),
                      F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)

    text = F.coalesce(F.array_join(F.transform(parts, piece), "\n"), _plain_text(raw), F.lit(""))
    return rows.filter(role.isin("user", "assistant")).select(
        "conv_id", "title", "when", "turn", role.alias("role"), text.alias("content"))


def parse_messages(files: DataFrame) -> DataFrame:
    """Generic {messages: [{role, content}]} objects, one or a list."""
    layout = "title:string,messages:array<struct<role:string,content:string>>"
    convs = _conversations_of(files, layout).filter(F.col("c.messages").isNotNull())
    rows = convs.select("conv_id", F.col("c.title").alias("title"),
                        F.posexplode("c.messages").alias("turn", "m"))
    rows = rows.select("conv_id", "title", "turn", F.col("m.role").alias("role"),
                       F.col("m.content").alias("_raw"))
    return _block_texts(rows, "_raw", "content", ["conv_id", "turn"]).drop("_raw")


def read_chat_export_a(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat_export_a(read_files(spark, path))


def read_chat_export_b(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat_export_b(read_files(spark, path))


# --------------------------------------------------------------- transcripts
def parse_transcripts(files: DataFrame) -> DataFrame:
    """Turns of transcripts given as whole files (path, text)."""
    return parse_transcript_lines(file_lines(files))


def parse_transcript_lines(lines: DataFrame) -> DataFrame:
    """``User:`` / ``Assistant:`` texts by line (path, line, raw). Lines before the first speaker are dropped; a text
    without any speaker becomes context with a canned reply.

    Parts are numbered by the ordered scan, so a long text is cut; the lines of one part become one turn."""
    who = F.nullif(F.lower(F.regexp_extract("raw", SPEAKER, 1)), F.lit(""))
    rows = lines.select("path", "line", who.alias("_who"), F.when(
        who.isNotNull(), F.regexp_replace("raw", SPEAKER, "")).otherwise(F.col("raw")).alias("_t"))
    rows = scan(rows, ["path"], ["line"], running_sum={"turn": F.col("_who").isNotNull().cast("int")})
    parts = rows.groupBy(F.col("path").alias("conv_id"), "turn").agg(
        F.max("_who").alias("_who"),
        strip_blank(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_t"))), lambda p: p["_t"]), "\n"))
        .alias("_text"))
    spoken = parts.filter("turn > 0").select("conv_id", "turn", role_of(F.col("_who")).alias("role"), F.col("_text").alias("content"))
    silent = parts.join(spoken.select("conv_id").distinct(), "conv_id", "left_anti").filter("_text <> ''")
    canned = F.array(
        F.struct(F.lit("user").alias("role"), F.concat(F.lit(MATERIAL_INTRO), F.col("_text")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit(MATERIAL_REPLY).alias("content")))
    given = silent.select("conv_id", F.posexplode(canned).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")
    return spoken.unionByName(given)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcript_lines(read_lines(spark, path))


def detect_format(files: DataFrame) -> DataFrame:
    """Add ``format`` by name, first characters and keys: session_log, export_a, export_b, messages
    or transcript."""
    text = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+", "")
    head = F.substring(text, 1, 400)
    log = F.lower("path").endswith(".jsonl") | (
        text.startswith("{") & F.contains(head, F.lit('"type"'))
        & F.contains(F.col("text"), F.lit("\n{")))
    sample = F.coalesce(
        F.when(text.startswith("["), F.get(F.from_json(text, "array<map<string,string>>"), F.lit(0))),
        F.when(text.startswith("{"), F.from_json(text, "map<string,string>")),
    )
    keys = F.coalesce(F.map_keys(sample), F.array().cast("array<string>"))

    def has(k: str) -> Column:
        return F.array_contains(keys, F.lit(k))

    return files.withColumn(
        "format",
        F.when(log, "session_log").when(has("chat_messages"), "export_a")
        .when(has("mapping"), "export_b").when(has("messages"), "messages")
        .otherwise("transcript"),
    )


def parse_any(files: DataFrame) -> DataFrame:
    """Turns of every recognised format, routed by ``detect_format``."""
    tagged = detect_format(files)

    def of(name: str) -> DataFrame:
        return tagged.filter(F.col("format") == name).drop("format")

    shape = ["conv_id", "turn", "role", "content"]
    parts = [
        parse_session_logs(of("session_log"))[0], parse_chat_export_a(of("export_a")),
        parse_chat_export_b(of("export_b")), parse_messages(of("messages")),
        parse_transcripts(of("transcript")),
    ]
    out = None
    for p in parts:
        p = p.select(*shape).withColumn("turn", F.col("turn").cast("long"))
        out = p if out is None else out.unionByName(p)
    return out


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _heads(turns: DataFrame) -> DataFrame:
    """One row per conversation: its title, else the first 80 characters of its first turn that says something."""
    said = strip_blank(F.col("content"))
    named = F.nullif(strip_blank(F.coalesce("title", F.lit(""))), F.lit(""))
    return turns.groupBy("conv_id").agg(
        F.max(named).alias("_named"), F.max("when").alias("when"),
        F.min_by(F.substring(said, 1, 80), F.when(said != "", F.col("turn"))).alias("_first"),
    ).select("conv_id", F.coalesce("_named", "_first", F.lit("")).alias("title"), F.lit("").alias("project"),
             F.coalesce("when", F.lit("")).alias("when"))


def conversations(files: DataFrame) -> DataFrame:
    """Every conversation of the files, of any recognised format: conv_id, title, project, when ('' if unknown).

    Exports and message lists without a title go by their first turn, transcripts by the name of their file."""
    tagged = detect_format(files)

    def of(name: str) -> DataFrame:
        return tagged.filter(F.col("format") == name).drop("format")

    listed = parse_messages(of("messages")).withColumn("when", F.lit(""))
    told = parse_transcripts(of("transcript")).withColumns({"title": _stem(F.col("conv_id")), "when": F.lit("")})
    shape = ["conv_id", "title", "project", "when"]
    out = parse_session_logs(of("session_log"))[1].select(*shape)
    for turns in (parse_chat_export_a(of("export_a")), parse_chat_export_b(of("export_b")), listed, told):
        out = out.unionByName(_heads(turns).select(*shape))
    return out
