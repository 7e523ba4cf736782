"""Event files to metadata-only traces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winledger.functions.jsontext import json_outline
from winledger.functions.text import fingerprint, slugify, strip_blank, strip_variables, word_shingles
from winledger.schema import MONEY, RAW_EVENT, TRACE, VERIFICATION

SCHEMA_VERSION = "1.0"
ZONED = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)\z"
)
UUID = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?\z"
COPIES_PER_ROW = 100_000

# Closed vocabularies of a verification.
STATUSES = ("pass", "fail", "unknown")
METHODS = ("programmatic", "downstream", "judge")
GRADES = ("measured", "derived", "declared")


def _raw_schema() -> T.StructType:
    """The event with tool arguments of any JSON kind and a place for unreadable lines."""
    fields = []
    for f in RAW_EVENT.fields:
        if f.name == "tool_calls":
            inner = [T.StructField(c.name, T.VariantType() if c.name == "args" else c.dataType)
                     for c in f.dataType.elementType.fields]
            f = T.StructField("tool_calls", T.ArrayType(T.StructType(inner)))
        fields.append(f)
    return T.StructType([*fields, T.StructField("_corrupt", T.StringType())])


def instant(text: Column) -> Column:
    """A timestamp from ISO text that names its zone, else NULL."""
    return F.regexp_extract(text, ZONED, 0).try_cast("timestamp")


def whole_number(text: Column) -> Column:
    """A whole number written as such or as 3.0, else NULL."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)(\.0*)?\s*\z", 1).try_cast("long")


def _count_ok(c: Column, low: int = 0) -> Column:
    """Absent, or a whole number of at least ``low``."""
    return c.isNull() | F.coalesce(whole_number(c) >= low, F.lit(False))


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``violations``: the names of the rules each raw event breaks (empty for a valid one)."""
    start, end = instant(F.col("ts_start")), instant(F.col("ts_end"))
    v = F.col("verification")

    def said(k: str) -> Column:
        return F.try_element_at(v, F.lit(k))

    confidence = said("confidence").try_cast("double")
    five = F.array(*[F.lit(k) for k in VERIFICATION.names])
    verified = (
        (F.size(F.array_except(F.map_keys(v), five)) == 0)
        & said("status").isin(*STATUSES) & said("method").isin(*METHODS)
        & said("evidence_grade").isin(*GRADES)
        & said("signal").rlike(r"^[a-z0-9_]{1,64}\z") & confidence.between(0.0, 1.0)
    )
    slug = r"(?U)^[A-Za-z0-9]([\w.:/+-]{0,127})\z"
    calls = F.coalesce("tool_calls", F.array().cast(events.schema["tool_calls"].dataType))
    bad_call = F.exists(calls, lambda c: c["name"].isNull() | ~_count_ok(c["ts_offset_ms"])
                        | ~_count_ok(c["duration_ms"]) | ~slugify(c["name"]).rlike(slug)
                        | ~slugify(F.coalesce(c["status"], F.lit("ok")), 32)
                        .rlike(r"^[A-Za-z0-9_-]{1,32}\z"))
    messages = F.coalesce("messages", F.array().cast(events.schema["messages"].dataType))

    def slug_ok(name: str, required: bool, pattern: str = slug) -> Column:
        c = F.col(name)
        return F.coalesce(slugify(c, 40).rlike(pattern), F.lit(False)) & (
            c.isNotNull() if required else F.lit(True))

    def uuid_ok(name: str) -> Column:
        return F.col(name).isNull() | F.col(name).rlike(UUID)

    rules = {
        "malformed": F.col("_corrupt").isNull() if "_corrupt" in events.columns else F.lit(True),
        "provider": slug_ok("provider", True),
        "model_id": slug_ok("model_id", True),
        "model_version_hint": slug_ok("model_version_hint", False),
        "endpoint_region": slug_ok("endpoint_region", False, r"^[A-Za-z0-9_-]{1,64}\z"),
        "ts_start": start.isNotNull(),
        "ts_end": end.isNotNull(),
        "end_before_start": start.isNull() | end.isNull() | (end >= start),
        "tokens": reduce(lambda a, b: a & b, [
            _count_ok(F.col(f"tokens.{n}")) for n in ("input", "input_cached", "output", "reasoning")]),
        "cost_usd": F.col("cost_usd").isNull() | F.col("cost_usd").try_cast("decimal(38,18)").isNotNull(),
        "ttft_ms": _count_ok(F.col("ttft_ms")),
        "total_ms": _count_ok(F.col("total_ms")),
        "attempt_no": _count_ok(F.col("attempt_no"), 1),
        "messages": ~F.exists(messages, lambda m: m["role"].isNull()),
        "tool_calls": ~bad_call,
        "trace_id": uuid_ok("trace_id"),
        "task_id": uuid_ok("task_id"),
        "verification": v.isNull() | F.coalesce(verified, F.lit(False)),
    }
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return events.withColumn("violations", broken)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their place (see ``placed``)."""
    return placed(spark.read.text(path).select("value", *PLACE_COLUMNS))


PLACE_COLUMNS = ("_metadata.file_path", "_metadata.file_block_start")


def placed(lines: DataFrame) -> DataFrame:
    """``value`` and ``_place``, the file and the number of the line in it, of lines just read from files (``value``,
    ``file_path``, ``file_block_start``). How files were cut into blocks does not show in it.

    Lines are numbered where they are read, from the beginning of their block; how many lines come before a block is
    a table with a row for each block but the first of a file, which is small enough to be broadcast."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            path, block = batch.column(1), batch.column(2)
            moved = pc.or_(pc.not_equal(path.slice(1), path.slice(0, size - 1)),
                           pc.not_equal(block.slice(1), block.slice(0, size - 1)))
            begin = np.concatenate(([0], np.nonzero(moved.to_numpy(zero_copy_only=False))[0] + 1))
            lengths = np.diff(np.append(begin, size))
            nth = np.arange(size) - np.repeat(begin, lengths)
            if (path[0].as_py(), block[0].as_py()) == last:
                nth[:lengths[0]] += done
            last, done = (path[size - 1].as_py(), block[size - 1].as_py()), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "_nth"])

    read = lines.select("value", "file_path", "file_block_start")
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (read.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL")
              .select(F.col("file_path").alias("_path"), F.col("file_block_start").alias("_block"), "_before"))
    numbered = read.mapInArrow(number, "value string, file_path string, file_block_start long, _nth long").join(
        F.broadcast(blocks), (F.col("file_path") == F.col("_path")) & (F.col("file_block_start") == F.col("_block")), "left")
    line = (F.coalesce("_before", F.lit(0)) + F.col("_nth")).cast("string")
    return numbered.select("value", F.concat_ws("#", "file_path", line).alias("_place"))


def checked_events(lines: DataFrame, *, mode: str = "count") -> DataFrame:
    """All events of JSON lines with ``violations``, for ``split_checked``."""
    if mode not in ("count", "strict"):
        raise ValueError("mode is 'count' or 'strict'")
    # Ends are trimmed by character set: a pattern would walk the whole line.
    given = F.expr("trim(both ' \\t\\n\\r\\f' from value)")
    place = ["_place"] if "_place" in lines.columns else []
    text = lines.select(given.alias("_line"), *place).filter(F.col("_line") != "")
    parsed = F.from_json("_line", _raw_schema(), {"columnNameOfCorruptRecord": "_corrupt"})
    whole = F.col("_line").startswith("{") & F.col("_line").endswith("}")
    # The observed line count is part of the result of a run, and it fixes the parse as one step:
    # filters on parsed fields are not pushed below it, where they would repeat the parse per field.
    rows = (
        text.select("_line", *place, parsed.alias("_e"), whole.alias("_whole"))
        .observe(f"event_lines_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("n_lines"))
        .select("_line", *place, "_e.*", "_whole")
        .withColumn("_corrupt", F.when(~F.col("_whole"), F.col("_line")).otherwise(F.col("_corrupt")))
        .drop("_whole")
    )
    checked = validate_events(rows)
    good = F.size("violations") == 0
    if mode == "strict":
        fail = F.raise_error(F.concat(F.lit("invalid event: "), F.array_join("violations", ", ")))
        checked = checked.withColumn(
            "violations", F.when(good, F.col("violations")).otherwise(fail.cast("array<string>")))
    return checked


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects); a caller that needs both may persist what is checked, so that it is parsed once."""
    good = F.size("violations") == 0
    events = checked.filter(good).drop("violations", "_corrupt")
    rejects = checked.filter(~good).select(
        F.col("_line").alias("line"), "violations", *[c for c in ("_place",) if c in checked.columns])
    return events, rejects


def parse_events(lines: DataFrame, *, mode: str = "count") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from JSON lines (column ``value``). Blank lines are skipped; in mode
    'count' bad lines go to ``rejects`` with their violations, in mode 'strict' they are an error."""
    return split_checked(checked_events(lines, mode=mode))


def read_events(spark: SparkSession, path: str, *, mode: str = "count") -> tuple[DataFrame, DataFrame]:
    """Events and rejects of a JSON-lines file, folder or glob."""
    return parse_events(read_lines(spark, path), mode=mode)


def named_uuid(*parts: Column) -> Column:
    """A UUID (version 8: from a digest) that is a function of its parts."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def with_ids(events: DataFrame, tenant_id: str) -> DataFrame:
    """Fill missing trace ids, so that re-reading a file gives the same ids and equal lines stay apart: from the place of
    the line (file and line number), and for lines that do not come from files from the line and its copy number.

    In the second case equal lines are combined into one row with a count before the shuffle and written out again
    afterwards, so a line that makes up much of the input does not gather in one task."""
    if "_place" in events.columns:
        given = named_uuid(F.lit(tenant_id), F.col("_place"))
        return events.withColumn("trace_id", F.coalesce("trace_id", given))
    named = events.filter(F.col("trace_id").isNotNull())
    bare = events.filter(F.col("trace_id").isNull())
    rest = [c for c in events.columns if c not in ("_line", "trace_id")]
    # Columns follow from the line, so any row of a group stands for all of them.
    counted = bare.groupBy("_line").agg(
        *[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES_PER_ROW}"))))
    spread = blocks.withColumn("_copy", F.explode(F.sequence(
        F.col("_block") * COPIES_PER_ROW + 1,
        F.least(F.col("_n"), (F.col("_block") + 1) * COPIES_PER_ROW))))
    given = spread.withColumn("trace_id", named_uuid(F.lit(tenant_id), F.col("_line"), F.col("_copy").cast("string")))
    return named.unionByName(given.select(*events.columns))


def output_shape(text: Column, salt: str) -> Column:
    """What an output looks like without its content."""
    outline = json_outline(text)
    blocks = F.regexp_count(text, F.lit(r"(?s)```.*?```"))
    outside = strip_blank(F.regexp_replace(text, r"(?s)```.*?```", ""))
    valid = outline.isNotNull()
    kind = (
        F.when(valid, "json").when((blocks > 0) & (outside == ""), "code")
        .when(blocks > 0, "mixed").otherwise("text")
    )
    return F.struct(
        kind.alias("type"),
        F.length(text).cast("long").alias("n_chars"),
        valid.alias("json_valid"),
        F.when(valid, fingerprint(outline, salt)).alias("schema_fingerprint"),
        (blocks > 0).alias("has_code_block"),
        blocks.cast("long").alias("n_code_blocks"),
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(whole_number(F.col(name)), F.lit(0))


def shingles(text: Column, salt: str, size: int = 5) -> Column:
    """Salted hashes of the word n-grams of a text, for overlap without content."""
    return F.transform(word_shingles(text, size), lambda g: F.substring(
        F.sha2(F.concat(F.lit(salt), g), 256), 1, 16))


# What stands before a comma, a colon or the end of compact JSON, strings taken whole, and that mark.
BETWEEN_PARTS = r'((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:]|\z)'


def spaced(compact: Column) -> Column:
    """Compact JSON with a blank after every comma and colon between its parts."""
    return F.rtrim(F.regexp_replace(compact, BETWEEN_PARTS, "$1$2 "))


def normalize(events: DataFrame, tenant_id: str, salt: str) -> DataFrame:
    """Valid raw events as traces: ids, times, counts and salted fingerprints, no content."""
    messages = F.coalesce("messages", F.array().cast(events.schema["messages"].dataType))
    calls = F.coalesce("tool_calls", F.array().cast(events.schema["tool_calls"].dataType))

    def body(m: Column) -> Column:
        return F.coalesce(m["content"], F.lit(""))

    system = F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "system"), F.lit(0))["content"],
                        F.lit(""))
    said = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), body(m))), "\n")
    start, end = instant(F.col("ts_start")), instant(F.col("ts_end"))
    span = F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)).cast("long")
    total = _or_zero("total_ms")
    v = F.col("verification")

    def call(c: Column) -> Column:
        # Variant objects keep their keys sorted, so equal arguments give equal text; a blank follows ',' and ':'.
        args = spaced(F.coalesce(F.to_json(c["args"]), F.lit("null")))
        return F.struct(
            slugify(c["name"]).alias("name"),
            fingerprint(args, salt).alias("args_fingerprint"),
            F.coalesce(whole_number(c["ts_offset_ms"]), F.lit(0)).alias("ts_offset_ms"),
            F.coalesce(whole_number(c["duration_ms"]), F.lit(0)).alias("duration_ms"),
            slugify(F.coalesce(c["status"], F.lit("ok")), 32).alias("status"),
        )

    given = F.struct(*[
        (F.try_element_at(v, F.lit(f.name)).try_cast(f.dataType)).alias(f.name)
        for f in VERIFICATION.fields])
    none = F.struct(
        F.lit("unknown").alias("status"), F.lit("programmatic").alias("method"),
        F.lit("none").alias("signal"), F.lit(0.0).alias("confidence"),
        F.lit("declared").alias("evidence_grade"))
    out = events.withColumn("_said", said).select(
        F.col("trace_id"),
        F.lit(tenant_id).alias("tenant_id"),
        F.coalesce("task_id", "trace_id").alias("task_id"),
        F.coalesce(whole_number(F.col("attempt_no")), F.lit(1)).alias("attempt_no"),
        start.alias("ts_start"), end.alias("ts_end"),
        slugify(F.col("provider"), 40).alias("provider"),
        slugify(F.col("model_id"), 40).alias("model_id"),
        slugify(F.col("model_version_hint"), 40).alias("model_version_hint"),
        slugify(F.col("endpoint_region"), 40).alias("endpoint_region"),
        F.struct(*[_or_zero(f"tokens.{n}").alias(n)
                   for n in ("input", "input_cached", "output", "reasoning")]).alias("tokens"),
        F.coalesce(F.col("cost_usd").try_cast(MONEY), F.lit(0).cast(MONEY)).alias("cost_usd"),
        F.struct(_or_zero("ttft_ms").alias("ttft_ms"),
                 F.when(total == 0, span).otherwise(total).alias("total_ms")).alias("latency"),
        F.struct(
            F.size(messages).cast("long").alias("n_messages"),
            F.reduce(messages, F.lit(0), lambda n, m: n + F.length(body(m))).cast("long").alias("n_chars"),
            F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
            fingerprint(strip_variables(system), salt).alias("system_prompt_fingerprint"),
            fingerprint(F.col("_said"), salt).alias("input_fingerprint"),
        ).alias("input_shape"),
        output_shape(F.coalesce("output_text", F.lit("")), salt).alias("output_shape"),
        F.transform(calls, call).alias("tool_calls"),
        F.when(v.isNotNull(), given).otherwise(none).alias("verification"),
        F.lit("metadata_only").alias("redaction_level"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.nullif(F.col("session_id"), F.lit("")).alias("session_id"),
        F.col("task_id").alias("explicit_task_id"),
        shingles(F.col("_said"), salt).alias("input_shingles"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACE.fields])


def ingest(lines: DataFrame, tenant_id: str, salt: str, *, mode: str = "count"):
    """(traces, rejects) from JSON lines."""
    events, rejects = parse_events(lines, mode=mode)
    return normalize(with_ids(events, tenant_id), tenant_id, salt), rejects


# -------------------------------------------------------------- gateway logs
_USAGE = (
    "struct<prompt_tokens:double,completion_tokens:double,"
    "prompt_tokens_details:struct<cached_tokens:double>,"
    "completion_tokens_details:struct<reasoning_tokens:double>>"
)
GATEWAY_KWARGS = (
    "struct<model:string,custom_llm_provider:string,litellm_session_id:string,response_cost:string,"
    "messages:array<struct<role:string,content:string>>>"
)
GATEWAY_RESPONSE = f"struct<usage:{_USAGE},choices:array<struct<message:struct<content:string>>>>"


def events_from_gateway_log(log: DataFrame) -> DataFrame:
    """Raw events from a gateway's callback log (kwargs, response as JSON text; start, end as text;
    failed as boolean). A failed call fails its verification; a time without a zone is UTC."""
    k, r = F.col("_k"), F.col("_r")
    rows = log.withColumn("_k", F.from_json("kwargs", GATEWAY_KWARGS)).withColumn(
        "_r", F.from_json("response", GATEWAY_RESPONSE))

    def zoned(c: str) -> Column:
        has = F.col(c).rlike(r"([Zz]|[+-]\d{2}(:?\d{2})?)\z") & F.col(c).rlike(r":\d{2}")
        return F.when(has, F.col(c)).otherwise(F.concat(c, F.lit("Z")))

    def named(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))

    def count(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0)).cast("long").cast("string")

    failure = F.create_map(*[F.lit(x) for x in (
        "status", "fail", "method", "programmatic", "signal", "api_error", "confidence", "1.0",
        "evidence_grade", "measured")])
    none = F.lit(None).cast("string")
    messages = F.coalesce(k["messages"], F.array().cast("array<struct<role:string,content:string>>"))
    raw = _raw_schema()
    return rows.select(
        named(k["custom_llm_provider"]).alias("provider"), named(k["model"]).alias("model_id"),
        none.alias("model_version_hint"), none.alias("endpoint_region"),
        zoned("start").alias("ts_start"), zoned("end").alias("ts_end"),
        F.transform(messages, lambda m: F.struct(
            F.coalesce(m["role"], F.lit("user")).alias("role"),
            F.coalesce(m["content"], F.lit("")).alias("content"))).alias("messages"),
        F.coalesce(F.get(r["choices"], F.lit(0))["message"]["content"], F.lit("")).alias("output_text"),
        F.lit(False).alias("has_attachments"),
        F.struct(
            count(r["usage"]["prompt_tokens"]).alias("input"),
            count(r["usage"]["prompt_tokens_details"]["cached_tokens"]).alias("input_cached"),
            count(r["usage"]["completion_tokens"]).alias("output"),
            count(r["usage"]["completion_tokens_details"]["reasoning_tokens"]).alias("reasoning"),
        ).alias("tokens"),
        F.coalesce(k["response_cost"], F.lit("0")).alias("cost_usd"),
        none.alias("ttft_ms"), none.alias("total_ms"),
        F.lit(None).cast(raw["tool_calls"].dataType).alias("tool_calls"),
        F.nullif(k["litellm_session_id"], F.lit("")).alias("session_id"),
        none.alias("trace_id"), none.alias("task_id"), none.alias("attempt_no"),
        F.when(F.coalesce("failed", F.lit(False)), failure).alias("verification"),
        F.to_json(F.struct("kwargs", "response", "start", "end", "failed")).alias("_line"),
    )


def merge_traces(existing: DataFrame, new: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Insert or replace by trace id: new rows win over existing ones, and among new rows the one
    with the largest ``seq``. Copies are combined before the shuffle."""
    shape = [c for c in existing.columns if c != seq]
    place = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    both = existing.select(F.struct(*shape).alias("_t"), F.lit(-1).cast("long").alias("_s")).unionByName(
        new.select(F.struct(*shape).alias("_t"), place.alias("_s")))
    won = both.groupBy(F.col("_t.tenant_id").alias("_tenant"), F.col("_t.trace_id").alias("_id")).agg(
        F.max_by("_t", "_s").alias("_t"))
    return won.select("_t.*")
