"""Steps that must not be done twice or on more than they need."""

from pyspark.sql import functions as F

from winledger.operators import cluster, guard, tasks, waste
from winledger.plans import adapters as ad
from winledger.plans import ordered


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_made_once(spark):
    d = spark.createDataFrame([(1, "token = " + "a" * 20)], "doc_id long, text string")
    found = guard.find_secrets(d)
    assert _plan(found).count("contains(") <= 30
    assert [tuple(r) for r in found.select("doc_id", "what").collect()] == [(1, "generic api key")]


def test_large_keys_are_cut_below_a_million_rows(spark):
    rows = spark.range(2_000_000).select(F.lit(0).alias("k"), F.col("id"))
    points = ordered._cuts(rows, ["k"], ["id"]).select(F.size(F.flatten("_cuts")).alias("n")).head()["n"]
    assert points >= 5


def test_tasks_list_models_by_first_use(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir).withColumn(
        "model_id", F.when(F.col("model_id") != "model-3", F.col("model_id")))  # one model without a name
    got = tasks.tasks_from(a)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in sorted(a.select("tenant_id", "task_id", "ts_start", "trace_id", "model_id").collect(), key=lambda r: (r[2], r[3])):
        seen = want.setdefault((r[0], r[1]), [])
        if r[4] not in seen:
            seen.append(r[4])
    assert {(r[0], r[1]): r[2] for r in got.select("tenant_id", "task_id", "models_used").collect()} == want


def test_waste_reads_its_tasks_once(spark, sf_dir):
    a = ad.attempts_from_lineitem(spark, sf_dir)
    t = tasks.tasks_from(a)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = t.mapInArrow(counted, t.schema)
    waste.waste_total(seen, a, ad.prices_from_nation(spark, sf_dir)).collect()
    assert read.value == t.count()


def test_features_carry_only_what_they_read(spark, sf_dir):
    rep = tasks.representative(ad.attempts_from_lineitem(spark, sf_dir), cluster.needed())
    assert rep.schema["input_shape"].dataType.names == ["system_prompt_fingerprint"]
    assert rep.schema["tool_calls"].dataType.elementType.names == ["name"]
    assert "schema_fingerprint" not in rep.schema["output_shape"].dataType.names
