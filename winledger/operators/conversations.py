"""Conversation turns: normalising, summarising, and compacting prompts.

``turns`` is (conv_id, turn, role, content), ``turn`` giving the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winledger.functions.text import strip_blank
from winledger.plans.ordered import Ordered, scan

MAX_HISTORY_CHARS = 120_000

# Names under which an assistant speaks.
ASSISTANT_ROLES = ("assistant", "model", "ai", "claude", "chatgpt", "gpt", "bot")

# The verbose prompt a saving is measured against.
NAIVE_PREAMBLE = (
    "You are an extremely helpful, thorough and knowledgeable AI assistant. "
    "Please think carefully and reason step by step, explain your reasoning in "
    "detail, be as complete and comprehensive as possible, and always double-check "
    "your work before you answer. Here is what I need you to do: "
)
NAIVE_SUFFIX = " Please make sure to explain everything thoroughly and completely."
# Words that add length and no instruction, and words that ask for JSON.
FILLER = (
    r"(?iU)\b(please|kindly|could you|can you|would you|i would like you to|"
    r"i want you to|i need you to|for me|as an ai|if possible|thank you|thanks|"
    r"just|really|very|basically|actually)\b"
)
JSON_HINT = r"(?iU)\b(json|fields?|extract|schema|object|list of|table|csv)\b"
CONVENTIONS = (
    ("claude", "role and constraints first, tagged structure, positive instructions"),
    ("gpt", "concise system, fenced schema, explicit refusal rules"),
    ("gemini", "short declarative instruction, restate the format at the end"),
)
DEFAULT_CONVENTION = "explicit output contract, no preamble"


def role_of(role: Column) -> Column:
    return F.when(F.lower(F.coalesce(role, F.lit(""))).isin(*ASSISTANT_ROLES), "assistant").otherwise(
        "user")


def normalise_turns(
    turns: DataFrame, *, max_chars: int = MAX_HISTORY_CHARS, key: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Turns every provider accepts: strict user/assistant alternation from a user to an assistant,
    same-role runs merged, empties dropped, oldest pairs dropped until ``max_chars`` fit.

    What to keep is decided on run lengths; only then are the kept texts put together."""
    key = list(key)
    rows = turns.select(
        *key, "turn", role_of(F.col("role")).alias("role"),
        strip_blank(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("content"),
    ).filter(F.col("content") != "")
    runs = (
        Ordered(rows, key, ["turn"])
        .add(lag={"_was": F.col("role")})
        .map(lambda d: d.withColumn(
            "_opens", (~F.col("_was").eqNullSafe(F.col("role"))).cast("int")))
        .add(running_sum={"_run": F.col("_opens")})
        .result()
    )
    lengths = runs.groupBy(*key, "_run").agg(
        F.first("role").alias("_who"),
        (F.sum(F.length("content")) + 2 * (F.count(F.lit(1)) - 1)).alias("_len"),
    )
    # Counted from the newest run: a final user run is left out, then runs pair up as
    # (assistant, user before it), and a leading assistant run has no partner.
    back = Ordered(lengths.withColumn("_back", -F.col("_run")), key, ["_back"])
    back.add(lag={"_later": F.col("_run")}, lead={"_partner": F.col("_len")})
    ends_open = F.col("_later").isNull() & (F.col("_who") == "user")
    back.map(lambda d: d.withColumn("_in", (~ends_open).cast("int")))
    back.add(running_sum={"_seat": F.col("_in"), "_sum": F.col("_in") * F.col("_len")})
    asks = F.col("_who") == "user"
    ranked = (
        back.result().filter("_in = 1").filter(asks | F.col("_partner").isNotNull())
        .withColumn("_pair", F.expr("(_seat - 1) div 2"))
        .withColumn("_suffix", F.col("_sum") + F.when(asks, 0).otherwise(F.col("_partner")))
        .withColumn("_kept", (F.col("_suffix") <= max_chars) | (F.col("_pair") == 0))
    )
    counts = ranked.groupBy(*key).agg(
        F.max("_pair").alias("_oldest"),
        F.max(F.when(F.col("_kept"), F.col("_pair"))).alias("_first"),
    )
    chosen = ranked.filter("_kept").join(counts, key).select(
        *key, "_run",
        (2 * (F.col("_first") - F.col("_pair")) + F.when(asks, 0).otherwise(1)).alias("_pos"),
        (F.col("_oldest") - F.col("_first")).alias("_dropped"),
    )
    merged = (
        runs.join(chosen, [*key, "_run"])
        .groupBy(*key, "_run")
        .agg(
            F.first("role").alias("role"), F.first("_pos").alias("_pos"),
            F.first("_dropped").alias("_dropped"),
            F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("_parts"),
        )
    )
    text = F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n")
    first = F.col("_pos") == 0
    long_text = F.length("_text") > max_chars
    cut = F.when(first & long_text, F.expr(f"right(_text, {max_chars})")).otherwise(F.col("_text"))
    note = F.format_string(
        "[imported — %d earlier exchange(s) omitted to fit the prompt budget]\n\n", "_dropped")
    return merged.withColumn("_text", text).select(
        *key,
        F.col("_pos").alias("turn"),
        "role",
        F.when(first & (F.col("_dropped") > 0), F.concat(note, cut)).otherwise(cut).alias("content"),
    )


def summarise_conversations(turns: DataFrame, *, key: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Exchanges, characters and estimated tokens per conversation."""
    chars = F.sum(F.length("content"))
    return turns.groupBy(*key).agg(
        F.expr("count(1) div 2").alias("turns"), chars.alias("chars"),
        F.floor(chars / 4).cast("long").alias("est_tokens"),
    )


def est_tokens(text: Column) -> Column:
    """About four characters per token, at least one, halves to even."""
    return F.greatest(F.lit(1.0), F.rint(F.length(text) / 4)).cast("long")


def compact_prompts(
    prompts: DataFrame, *, intent: str = "intent", model: str = "target_model"
) -> DataFrame:
    """A lean prompt for each plain-language intent and the tokens it saves."""
    raw = strip_blank(F.col(intent))
    bare = F.regexp_replace(F.regexp_replace(F.col(intent), FILLER, ""), r"(?U)[\s\x1c-\x1f]+", " ")
    bare = strip_blank(F.regexp_replace(bare, r"^[ .,\t\n]+|[ .,\t\n]+\z", ""))
    core = F.when(bare != "", bare).otherwise(raw)
    low = F.lower(F.col(model))
    style = F.coalesce(
        *[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in CONVENTIONS],
        F.lit(DEFAULT_CONVENTION),
    )
    system = F.concat(
        F.when(F.col(intent).rlike(JSON_HINT), "Return ONLY valid JSON, no prose. Style: ")
        .otherwise("Answer directly in one pass, no preamble. Style: "),
        style, F.lit("."),
    )
    rows = prompts.withColumns({"_core": core, "system": system, "convention": style})
    capital = F.concat(F.upper(F.substring("_core", 1, 1)), F.expr("substring(_core, 2)"))
    user = F.when(
        F.col("_core") != "", F.concat(F.regexp_replace(capital, r"\.+\z", ""), F.lit("."))
    ).otherwise("")
    rows = rows.withColumn("user", user)
    naive = est_tokens(F.concat(F.lit(NAIVE_PREAMBLE), raw, F.lit(NAIVE_SUFFIX)))
    lean = est_tokens(F.concat_ws(" ", "system", "user"))
    saved = F.greatest(F.lit(0), F.col("naive_tokens") - F.col("optimized_tokens"))
    return (
        rows.withColumn("naive_tokens", naive).withColumn("optimized_tokens", lean)
        .withColumn("saved_tokens", saved)
        .withColumn("saved_pct", F.rint(F.col("saved_tokens") / F.col("naive_tokens") * 100)
                    .cast("long"))
        .drop("_core")
    )
