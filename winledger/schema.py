"""Table layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(20, 9)
MONEY_SUM = T.DecimalType(28, 12)
"""A sum of money is cast to this before a division, so the quotient keeps its digits."""

VERIFICATION = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("signal", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence_grade", T.StringType()),
])

TOKENS = T.StructType([
    T.StructField("input", T.LongType()),
    T.StructField("input_cached", T.LongType()),
    T.StructField("output", T.LongType()),
    T.StructField("reasoning", T.LongType()),
])

INPUT_SHAPE = T.StructType([
    T.StructField("n_messages", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("has_attachments", T.BooleanType()),
    T.StructField("system_prompt_fingerprint", T.StringType()),
    T.StructField("input_fingerprint", T.StringType()),
])

OUTPUT_SHAPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("json_valid", T.BooleanType()),
    T.StructField("schema_fingerprint", T.StringType()),
    T.StructField("has_code_block", T.BooleanType()),
    T.StructField("n_code_blocks", T.LongType()),
])

TOOL_CALL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("args_fingerprint", T.StringType()),
    T.StructField("ts_offset_ms", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("status", T.StringType()),
])

TRACE = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("attempt_no", T.LongType()),
    T.StructField("ts_start", T.TimestampType()),
    T.StructField("ts_end", T.TimestampType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("model_version_hint", T.StringType()),
    T.StructField("endpoint_region", T.StringType()),
    T.StructField("tokens", TOKENS),
    T.StructField("cost_usd", MONEY),
    T.StructField("latency", T.StructType([
        T.StructField("ttft_ms", T.LongType()),
        T.StructField("total_ms", T.LongType()),
    ])),
    T.StructField("input_shape", INPUT_SHAPE),
    T.StructField("output_shape", OUTPUT_SHAPE),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("verification", VERIFICATION),
    T.StructField("redaction_level", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("explicit_task_id", T.StringType()),
    T.StructField("input_shingles", T.ArrayType(T.StringType())),
])

# The event as it arrives, still carrying content. Times, ids and money are read as text and
# checked before they are cast; integers are read as text too, so 1.5 and "x" show as violations.
RAW_EVENT = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("model_version_hint", T.StringType()),
    T.StructField("endpoint_region", T.StringType()),
    T.StructField("ts_start", T.StringType()),
    T.StructField("ts_end", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
    T.StructField("output_text", T.StringType()),
    T.StructField("has_attachments", T.BooleanType()),
    T.StructField("tokens", T.StructType([
        T.StructField(n, T.StringType()) for n in ("input", "input_cached", "output", "reasoning")
    ])),
    T.StructField("cost_usd", T.StringType()),
    T.StructField("ttft_ms", T.StringType()),
    T.StructField("total_ms", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("args", T.StringType()),
        T.StructField("ts_offset_ms", T.StringType()),
        T.StructField("duration_ms", T.StringType()),
        T.StructField("status", T.StringType()),
    ]))),
    T.StructField("session_id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("attempt_no", T.StringType()),
    T.StructField("verification", T.MapType(T.StringType(), T.StringType())),
])

TEMPLATE = "input_shape.system_prompt_fingerprint"
STATUS = "verification.status"


def grade_rank(col):
    """Strongest evidence first: measured 0, derived 1, declared 2."""
    return F.when(col == "measured", 0).when(col == "derived", 1).when(col == "declared", 2)
