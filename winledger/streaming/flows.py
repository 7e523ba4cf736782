"""Streams built from built-in operators: ingest, session events, findings, windows, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.functions.rules import first_price
from winledger.operators import guard
from winledger.operators.drift import window_bounds
from winledger.plans.ordered import scan
from winledger.sources import events as ev
from winledger.sources import store
from winledger.sources.chats import BLOCK
from winledger.streaming import stateful

# Tools that change files, and how a passing run reads.
PROGRESS_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
PASSING = r"(?iU)\b(\d+ passed|all tests passed|tests? ok|build succeeded|exit code 0|OK)\b"

RECORD = (
    "type string, timestamp string, cwd string, message struct<model:string,content:string,"
    "usage:struct<output_tokens:bigint,input_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation_input_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>>>"
)
PLACE_BITS = 31
"""An event's id is its record's line and, in so many bits, its place in the record: a record is shorter than that."""


def stream_traces(spark: SparkSession, path: str, out: str, checkpoint: str, tenant_id: str, salt: str, *,
                  max_files: int = 100, **trigger):
    """Start a query that reads event files as they arrive into ``{out}/traces``, a table as ``sources.store`` keeps it,
    and writes bad lines with their violations and places to ``{out}/rejects``.

    A line without an id is identified by its file and line number, as in the batch reader, so copies count. A given
    id that comes again replaces its trace. A micro-batch is parsed once and may be repeated."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select("value", *ev.PLACE_COLUMNS)

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = ev.checked_events(ev.placed(batch)).persist()
        events, rejects = ev.split_checked(checked)
        rejects.withColumnRenamed("_place", "place").write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        store.upsert_traces(ev.normalize(ev.with_ids(events, tenant_id), tenant_id, salt), f"{out}/traces")
        checked.unpersist()

    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def record_time(raw: Column, fallback: Column) -> Column:
    """Seconds since the epoch: numbers as seconds, or milliseconds beyond 1e12, ISO text (without a
    zone taken as UTC), else the fallback."""
    number = raw.try_cast("double")
    iso = F.unix_micros(raw.try_cast("timestamp")) / 1e6
    return F.coalesce(F.when(number > 1e12, number / 1000).otherwise(number), iso, fallback)


def session_events(records: DataFrame, *, carry_model: bool = False) -> DataFrame:
    """Session activity from log records (tenant_id, session_id, line, raw, received_at, and perhaps ``model_hint``,
    what a record without a model goes by; ``stateful.carry_models`` adds it to a stream).

    An assistant record gives one turn and a call per tool block; a user record gives a progress
    event for tool results, else a human turn. ``carry_model`` (batch only) fills a missing model
    with the session's last one."""
    rows = records.withColumn("r", F.from_json("raw", RECORD)).filter(
        F.col("r.type").isin("assistant", "user"))
    raw = F.col("r.message.content")
    listed = F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>")
    blocks = F.transform(
        F.filter(listed, lambda b: F.ltrim(b).startswith("{")), lambda b: F.from_json(b, BLOCK))
    plain = F.array(F.struct(
        F.lit("text").alias("type"), raw.alias("text"), *[F.lit(None).cast("string").alias(n)
                                                          for n in ("name", "input", "content")]))
    given = [F.nullif(F.col("r.message.model"), F.lit("")), *([F.col("model_hint")] if "model_hint" in records.columns else [])]
    rows = rows.withColumn("model_id", F.coalesce(*given)).withColumn(
        "blocks", F.coalesce(blocks, F.when(raw.isNotNull(), plain), F.array().cast(
            "array<struct<type:string,text:string,name:string,input:string,content:string>>")))
    if carry_model:
        rows = scan(rows, ["tenant_id", "session_id"], ["line"], carry={"_m": F.col("model_id")})
        rows = rows.withColumn("model_id", F.col("_m")).drop("_m")
    usage = F.col("r.message.usage")

    def count(name: str) -> Column:
        return F.coalesce(usage[name], F.lit(0))

    out, cached = count("output_tokens"), count("cache_read_input_tokens")
    inp = count("input_tokens") + count("cache_creation_input_tokens")
    think = F.coalesce(usage["output_tokens_details"]["thinking_tokens"], F.lit(0))
    price = first_price(F.coalesce("model_id", F.lit("")))
    cost = (
        (inp + cached * F.lit(0.1)) * price["price_in"].cast("double")
        + out.cast("double") * price["price_out"].cast("double")
    ) / 1e6
    zero, blank, no = F.lit(0).cast("bigint"), F.lit(""), F.lit(False)

    def event(kind, *, o=zero, i=zero, t=zero, c=None, text=blank, tool=blank, args=blank, progress=no):
        return F.struct(
            F.lit(kind).alias("kind"), o.alias("out_tokens"), i.alias("in_tokens"),
            t.alias("thinking_tokens"), (F.lit(0.0) if c is None else c).alias("cost_usd"),
            text.alias("text"), tool.alias("tool"), args.alias("tool_args"),
            progress.alias("progress"))

    said = F.array_join(F.transform(
        F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], blank)), " ")
    turn = F.array(event("assistant", o=out, i=inp, t=think, c=cost, text=said))
    calls = F.transform(
        F.filter("blocks", lambda b: b["type"] == "tool_use"),
        lambda b: event(
            "tool", tool=F.coalesce(b["name"], blank),
            # Variant objects keep their keys sorted.
            args=F.substring(F.coalesce(F.to_json(F.try_parse_json(b["input"])), F.lit("{}")), 1, 600),
            progress=F.coalesce(b["name"].isin(*PROGRESS_TOOLS), no)))
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    body = F.array_join(F.transform(results, lambda b: F.coalesce(b["content"], blank)), "\n")
    human = F.array(F.when(F.size(results) > 0, event("progress", progress=body.rlike(PASSING)))
                    .otherwise(event("user", progress=F.lit(True))))
    happened = F.when(F.col("r.type") == "assistant", F.concat(turn, calls)).otherwise(human)
    ts = record_time(F.col("r.timestamp"), F.col("received_at").cast("double"))
    staged = rows.select("tenant_id", "session_id", "line", "model_id", ts.alias("ts"), happened.alias("_e"))
    return staged.select(
        "tenant_id", "session_id", "line", "model_id", "ts", F.posexplode("_e").alias("_i", "e")
    ).select(
        "tenant_id", "session_id",
        (F.shiftleft(F.col("line").cast("long"), PLACE_BITS) + F.col("_i")).alias("event_id"), "ts",
        "model_id", "e.*")


def outbound_text(records: DataFrame) -> DataFrame:
    """The tool-call inputs of assistant records, as the text that leaves: (…, text, cwd)."""
    rows = records.withColumn("r", F.from_json("raw", RECORD)).filter(F.col("r.type") == "assistant")
    raw = F.col("r.message.content")
    listed = F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>")
    inputs = F.transform(listed, lambda b: F.when(
        F.get_json_object(b, "$.type") == "tool_use", F.get_json_object(b, "$.input")))
    # String leaves of the inputs, unescaped, one per line: quoted pieces not followed by a colon.
    piece = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')

    def strings(i: Column) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(i, piece, 1).alias("s"),
                             F.regexp_extract_all(i, piece, 2).alias("k"))
        return F.array_join(F.transform(
            F.filter(found, lambda f: f["k"] == ""),
            lambda f: F.from_json(F.concat(F.lit('{"v":"'), f["s"], F.lit('"}')), "struct<v:string>")["v"]), "\n")

    leaves = F.transform(F.array_compact(inputs), strings)
    return rows.select("tenant_id", "session_id", "line", F.col("r.cwd").alias("cwd"),
                       F.array_join(leaves, "\n").alias("text"))


def stream_findings(
    texts: DataFrame, policy: Mapping[str, object] | None = None, *,
    key: Sequence[str] = ("tenant_id", "session_id"), text: str = "text", cwd: str | None = None,
    forget_s: float = stateful.FORGET_S,
) -> DataFrame:
    """Cage findings of outbound texts, each (kind, snippet) once per session; what a session has shown is forgotten
    ``forget_s`` after it arrived first."""
    found = guard.all_findings(F.col(text), guard.policy_columns(policy), F.col("_marks"), F.col(cwd) if cwd else None)
    rows = texts.withColumn("_marks", guard.marks(F.col(text))).select(*key, F.explode(found).alias("_f"))
    kept = rows.select(*key, "_f.*", F.current_timestamp().alias("_arrived")).withWatermark("_arrived", f"{int(forget_s)} seconds")
    return kept.dropDuplicatesWithinWatermark([*key, "kind", "snippet"]).drop("_arrived")


def stream_windows(tasks: DataFrame, *, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Canary windows from a stream of tasks (model_id, cluster_id, ts_start, succeeded,
    verification_grade): a window is emitted once the watermark has passed its end; later rows are
    dropped and show in the query's dropped-by-watermark count."""
    known = tasks.filter(F.col("verification_grade") != "unknown").withWatermark("ts_start", lateness)
    return (
        known.groupBy(window_bounds(width).alias("_w"), "model_id", "cluster_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("successes"))
        .select("model_id", "cluster_id", F.col("_w.start").alias("ts"), "n", "successes")
    )


def alert_payloads(alerts: DataFrame, *, source: str = "guard") -> DataFrame:
    """Alerts (level, title, body, session_id, ts) with the JSON a webhook would take."""
    text = F.concat(F.lit(f"{source} · "), "title", F.lit(": "), "body")
    payload = F.to_json(F.struct(
        text.alias("text"), "level", "title", "body", F.col("session_id").alias("session"), "ts"))
    return alerts.withColumn("payload", payload)


def write_alerts(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that appends alert payloads to a table. Each micro-batch owns one folder and
    overwrites it when it is retried, so a lost executor does not double alerts."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        alert_payloads(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
