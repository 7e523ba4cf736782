"""Per-cluster sections of a migration pack: contract, edge cases, tool policy, golden set.

Each section is one grouped job over all clusters. ``tasks`` carry ``cluster_id``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.jsontext import json_field_types
from winledger.operators.tasks import TASK, at, last_passing
from winledger.plans.ordered import scan

OUTPUT_TYPES = ("json", "text", "code", "mixed")
MIN_CONSTRAINT_SUPPORT = 3
GOLDEN_MINIMUM = 30
GOLDEN_FRACTION = 0.03
COST_STRATA = 3


def winners(
    tasks: DataFrame, task_attempts: DataFrame, columns: Mapping[str, Column], *, measured_only: bool = False
) -> DataFrame:
    """``columns`` of the last passing attempt of each task, with the task's cluster and cost."""
    info = tasks.filter(F.col("cluster_id").isNotNull()).select(
        "tenant_id", "task_id", "cluster_id", "total_cost_usd"
    )
    return last_passing(task_attempts, columns, measured_only=measured_only).join(
        info, TASK
    ).select("tenant_id", "task_id", *columns, "cluster_id", "total_cost_usd")


def nearest_rank_percentiles(
    df: DataFrame, col: str, by: Sequence[str], qs: Sequence[float]
) -> DataFrame:
    """The element at ``min(n - 1, int(q * n))`` of the sorted values; not interpolated.

    Works on counts per distinct value, so a large group is combined before it is ordered."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_cum", F.sum("_c").over(upto)).withColumn(
        "_n", F.sum("_c").over(group)
    )
    picks = []
    for q in qs:
        index = F.least(F.col("_n") - 1, F.floor(F.lit(float(q)) * F.col("_n")).cast("long"))
        picks.append(
            F.min(F.when(F.col("_cum") > index, F.col(col))).alias(f"p{round(q * 100)}")
        )
    return placed.groupBy(*by).agg(*picks)


def output_contract(tasks: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """What successful outputs of each cluster look like."""
    shape = {"type": "type", "schema": "schema_fingerprint", "valid": "json_valid", "n_chars": "n_chars"}
    won = winners(tasks, task_attempts, {
        "ts_start": F.col("ts_start"), "trace_id": F.col("trace_id"),
        **{name: F.col(f"output_shape.{field}") for name, field in shape.items()},
    }).select(
        "cluster_id", "ts_start", "trace_id", *shape,
    )
    kinds = won.groupBy("cluster_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"),
        F.min(at()).alias("first"),
    )
    top = F.struct(-F.col("n"), F.col("first"))
    by_type = kinds.groupBy("cluster_id").agg(
        F.sum("n").alias("n_successes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("_types"),
        F.min_by("type", top).alias("dominant_type"),
        (F.sum("valid") / F.sum("n")).alias("json_valid_rate"),
    )
    by_schema = (
        won.filter(F.col("schema").isNotNull()).groupBy("cluster_id", "schema")
        .agg(F.count(F.lit(1)).alias("n"), F.min(at()).alias("first"))
        .groupBy("cluster_id")
        .agg(F.min_by("schema", top).alias("dominant_schema_fingerprint"),
             F.max("n").alias("_schema_n"))
    )
    lengths = nearest_rank_percentiles(won, "n_chars", ["cluster_id"], [0.10, 0.50, 0.90])
    return (
        by_type.join(by_schema, "cluster_id", "left").join(lengths, "cluster_id", "left")
        .select(
            "cluster_id",
            "n_successes",
            F.transform_values("_types", lambda _, v: v / F.col("n_successes"))
            .alias("type_shares"),
            "dominant_type",
            "dominant_schema_fingerprint",
            (F.coalesce(F.col("_schema_n"), F.lit(0)) / F.col("n_successes"))
            .alias("dominant_schema_share"),
            "json_valid_rate",
            F.struct("p10", "p50", "p90").alias("length"),
        )
    )


def json_fields(outputs: DataFrame, by: Sequence[str], *, text: str = "output") -> DataFrame:
    """Union of the top-level fields of JSON-object outputs: presence share and type names."""
    parsed = outputs.select(*by, json_field_types(F.col(text)).alias("_f")).filter(
        F.col("_f").isNotNull()
    )
    loaded = parsed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    fields = (
        parsed.select(*by, F.explode("_f").alias("_f"))
        .groupBy(*by, F.col("_f.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("_c"),
             F.array_sort(F.collect_set("_f.type")).alias("types"))
    )
    joined = fields.join(loaded, list(by)) if by else fields.withColumn("_o", F.lit(1)).join(
        loaded.withColumn("_o", F.lit(1)), "_o").drop("_o")
    return joined.select(*by, "name", (F.col("_c") / F.col("_n")).alias("presence"), "types")


def deviations(contract: Column) -> Column:
    """Signatures of how an output departs from its cluster's contract."""
    shape = F.col("output_shape")
    low = contract["length"]["p10"]
    high = F.greatest(contract["length"]["p90"], low)
    schema = contract["dominant_schema_fingerprint"]
    return F.array_compact(F.array(
        F.when(shape["type"] != contract["dominant_type"], "type_mismatch"),
        F.when(shape["schema_fingerprint"] != schema, "schema_mismatch"),
        F.when(~shape["n_chars"].between(low, high), "length_outlier"),
    ))


def edge_cases(tasks: DataFrame, task_attempts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Passing tasks that departed from the contract, per signature, ranked by n x cost.

    The contract table has one row per cluster."""
    terms = contracts.select(
        "cluster_id",
        F.struct("dominant_type", "dominant_schema_fingerprint", "length").alias("_contract"),
    )
    found = winners(tasks, task_attempts, {"output_shape": F.col("output_shape")}).join(terms, "cluster_id").select(
        "cluster_id", "tenant_id", "task_id", "total_cost_usd",
        F.explode(deviations(F.col("_contract"))).alias("signature"),
    )
    sums = found.groupBy("cluster_id", "signature").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("total_cost_usd").cast("decimal(38,9)").alias("total_cost_usd"),
    )
    first = Window.partitionBy("cluster_id", "signature").orderBy("task_id", "tenant_id")
    examples = (
        found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= 3)
        .groupBy("cluster_id", "signature")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "task_id"))).alias("_e"))
        .withColumn("example_task_ids", F.transform("_e", lambda e: e["task_id"])).drop("_e")
    )
    weight = F.col("n_tasks") * F.col("total_cost_usd").cast("double")
    order = Window.partitionBy("cluster_id").orderBy(weight.desc(), "signature")
    return sums.join(examples, ["cluster_id", "signature"]).withColumn(
        "rank", F.row_number().over(order)
    )


def tool_sequences(tasks: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """Distinct tool sequences of winning attempts per cluster, with how many tasks used each.

    Identical sequences are combined here, before anything is generated from them."""
    return (
        winners(tasks, task_attempts, {"tools": F.transform("tool_calls", lambda c: c["name"])})
        .groupBy("cluster_id", "tools")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def tool_frequencies(tasks: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """Share of successful tasks that used each tool."""
    seqs = tool_sequences(tasks, task_attempts)
    totals = seqs.groupBy("cluster_id").agg(F.sum("n").alias("n_sequences"))
    used = (
        seqs.select("cluster_id", "n", F.explode(F.array_distinct("tools")).alias("tool"))
        .groupBy("cluster_id", "tool").agg(F.sum("n").alias("n_tasks"))
    )
    return used.join(totals, "cluster_id").select(
        "cluster_id", "tool", "n_tasks", (F.col("n_tasks") / F.col("n_sequences")).alias("share")
    )


def tool_transitions(tasks: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """Consecutive tool pairs with the probability of leaving ``src`` that way."""
    steps = F.expr(
        "transform(sequence(1, size(tools) - 1), "
        "i -> struct(tools[i - 1] as src, tools[i] as dst))"
    )
    pairs = (
        tool_sequences(tasks, task_attempts).filter(F.size("tools") >= 2)
        .select("cluster_id", "n", F.explode(steps).alias("s"))
        .groupBy("cluster_id", "s.src", "s.dst").agg(F.sum("n").alias("count"))
    )
    leaving = F.sum("count").over(Window.partitionBy("cluster_id", "src"))
    return pairs.withColumn("probability", F.col("count") / leaving)


def tool_order(
    tasks: DataFrame, task_attempts: DataFrame, *, min_support: int = MIN_CONSTRAINT_SUPPORT
) -> DataFrame:
    """"a before b" rules: seen together at least ``min_support`` times, never the other way.

    Only the order of first use matters, so sequences are first reduced to that order and counted;
    each distinct order yields its forward pairs once."""
    orders = (
        tool_sequences(tasks, task_attempts)
        .groupBy("cluster_id", F.array_distinct("tools").alias("tools"))
        .agg(F.sum("n").alias("n"))
        .filter(F.size("tools") >= 2)
    )
    forward = (
        orders.select("cluster_id", "n", "tools", F.posexplode("tools").alias("i", "before"))
        .select("cluster_id", "n", "before",
                F.explode(F.expr("slice(tools, i + 2, size(tools))")).alias("after"))
        .groupBy("cluster_id", "before", "after").agg(F.sum("n").alias("support"))
    )
    reverse = forward.select(
        "cluster_id", F.col("before").alias("after"), F.col("after").alias("before")
    )
    return (
        forward.filter(F.col("support") >= min_support)
        .join(reverse, ["cluster_id", "before", "after"], "left_anti")
        .withColumn("confidence", F.col("support") / (F.col("support") + 1))
    )


def template_refs(tasks: DataFrame, task_attempts: DataFrame) -> DataFrame:
    """The templates each cluster's attempts used."""
    seen = task_attempts.select(
        "tenant_id", "task_id", F.col("input_shape.system_prompt_fingerprint").alias("template")
    ).distinct()
    return (
        seen.join(tasks.filter(F.col("cluster_id").isNotNull())
                  .select("tenant_id", "task_id", "cluster_id"), ["tenant_id", "task_id"])
        .select("cluster_id", F.concat(F.lit("template://"), "template").alias("ref")).distinct()
    )


def golden_set(
    tasks: DataFrame, task_attempts: DataFrame, *, minimum: int = GOLDEN_MINIMUM,
    fraction: float = GOLDEN_FRACTION,
) -> DataFrame:
    """Measured successes of each cluster: all of them up to the target size, else terciles by cost,
    each spread evenly over output length. Ties go by task id.

    Ranks come from sliced scans, so one cluster may hold most of the tasks."""
    sizes = tasks.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_size"))
    pool = winners(tasks, task_attempts, {
        "trace_id": F.col("trace_id"), "verifier_spec": F.col("verification.signal"),
        "output_n_chars": F.col("output_shape.n_chars"),
    }, measured_only=True).select(
        "cluster_id", "tenant_id", "task_id", "trace_id", "total_cost_usd", "verifier_spec", "output_n_chars",
    )
    stats = (
        pool.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_m")).join(sizes, "cluster_id")
        .withColumn("_target", F.greatest(
            F.lit(minimum), F.ceil(F.lit(float(fraction)) * F.col("_size"))).cast("long"))
        .withColumn("_block", F.ceil(F.col("_m") / F.lit(COST_STRATA)).cast("long"))
        .drop("_size")
    )
    ranked = scan(
        pool, ["cluster_id"], ["total_cost_usd", "task_id", "tenant_id"],
        running_sum={"_rank": F.lit(1)},
    ).join(stats, "cluster_id")
    strata = ranked.withColumn("_stratum", F.expr("(_rank - 1) div _block"))
    placed = scan(
        strata, ["cluster_id", "_stratum"], ["output_n_chars", "_rank"],
        running_sum={"_seat": F.lit(1)},
    )
    quota = F.expr(f"_target div {COST_STRATA}") + F.when(
        F.col("_stratum") < F.col("_target") % COST_STRATA, 1
    ).otherwise(0)
    size = F.least(F.col("_block"), F.col("_m") - F.col("_stratum") * F.col("_block"))
    placed = placed.withColumn("_quota", quota).withColumn("_in", size)
    # Seat s is picked when int(i * size / quota) hits it for some i below the quota; only the
    # neighbours of s * quota / size can.
    placed = placed.withColumn("_step", F.col("_in") / F.nullif(F.col("_quota"), F.lit(0)))
    near = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = F.floor((F.col("_seat") - 1) / F.col("_step")) + d
        near = near | ((i >= 0) & (i < F.col("_quota")) & (F.floor(i * F.col("_step")) == F.col("_seat") - 1))
    keep = (
        (F.col("_m") <= F.col("_target"))
        | (F.col("_quota") >= F.col("_in"))
        | F.coalesce(near, F.lit(False))
    )
    return placed.filter(keep).select(
        "tenant_id",
        F.col("task_id").alias("case_id"),
        "cluster_id",
        F.format_string("trace://%s/input", "trace_id").alias("input_ref"),
        F.format_string("trace://%s/output", "trace_id").alias("expected_ref"),
        "verifier_spec",
        F.col("total_cost_usd").alias("cost_usd"),
        "output_n_chars",
    )
