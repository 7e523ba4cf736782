"""Lines and their places, the stored table, and live ingest."""

import datetime as dt
import json
import os

import numpy as np
from pyspark.sql import functions as F

from winledger.sources import events, store
from winledger.streaming import flows


def line(i, day=1, **more):
    return json.dumps({
        "provider": "p", "model_id": "m", "ts_start": f"2026-01-{day:02d}T00:00:{i % 60:02d}Z",
        "ts_end": f"2026-01-{day:02d}T00:01:00Z", "messages": [{"role": "user", "content": f"x{i}"}], "output_text": "y",
        "cost_usd": "0.5", **more})


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_places_do_not_depend_on_blocks(spark, tmp_path):
    put(tmp_path, "a.jsonl", [f"line {i % 7} é" for i in range(5000)])
    put(tmp_path, "b.jsonl", ["", "line 1", "", "line 1"])
    put(tmp_path, "c.jsonl", [])
    whole = {(r["_place"].split("/")[-1], r["value"]) for r in events.read_lines(spark, str(tmp_path)).collect()}
    assert whole == {(f"a.jsonl#{i}", f"line {i % 7} é") for i in range(5000)} | {
        ("b.jsonl#0", ""), ("b.jsonl#1", "line 1"), ("b.jsonl#2", ""), ("b.jsonl#3", "line 1"), ("c.jsonl#0", "")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        cut = events.read_lines(spark, str(tmp_path))
        assert cut.rdd.getNumPartitions() > 5
        assert {(r["_place"].split("/")[-1], r["value"]) for r in cut.collect()} == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bloom():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)
    bits = store.bloom(ids)
    assert store.may_hold(bits, ids).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).astype(np.uint64)
    assert store.may_hold(bits, others).mean() < 0.02
    assert store.may_hold(store.bloom(ids[:1]), ids[:1]).all()


def traces(spark, tmp_path, name, lines):
    put(tmp_path / name, "f.jsonl", lines)
    return events.ingest(events.read_lines(spark, str(tmp_path / name)), "t", "salt")[0]


def uid(i):
    return f"00000000-0000-4000-8000-{i:012d}"


def files(path, day):
    folder = f"{path}/date=2026-01-{day:02d}"
    return sorted(x for x in os.listdir(folder) if x.endswith(".parquet")) if os.path.isdir(folder) else []


def test_upsert_touches_few_days(spark, tmp_path):
    path = str(tmp_path / "table")
    first = [line(i, 1 + i % 6, trace_id=uid(i)) for i in range(300)]
    store.write_traces(traces(spark, tmp_path, "a", first), path)
    before = {d: files(path, d) for d in range(1, 9)}
    new = [line(3, 4, trace_id=uid(3), cost_usd="9"), line(900, 4, trace_id=uid(900)), line(901, 8, trace_id=uid(901))]
    assert store.upsert_traces(traces(spark, tmp_path, "b", new), path) == [dt.date(2026, 1, 4)]
    after = {d: files(path, d) for d in range(1, 9)}
    assert all(before[d] == after[d] for d in (1, 2, 3, 5, 6)) and not set(before[4]) & set(after[4]) and after[8]
    rows = {r["trace_id"]: r for r in store.read_traces(spark, path).collect()}
    assert len(rows) == 302 and float(rows[uid(3)]["cost_usd"]) == 9
    # The same again changes nothing; a trace that moves to another day leaves the old one, which may then be empty.
    store.upsert_traces(traces(spark, tmp_path, "b2", new), path)
    assert store.read_traces(spark, path).count() == 302
    store.upsert_traces(traces(spark, tmp_path, "c", [line(901, 7, trace_id=uid(901))]), path)
    rows = store.read_traces(spark, path)
    assert rows.count() == 302 and not files(path, 8)
    assert [r["d"] for r in rows.where(F.col("trace_id") == uid(901)).select(F.to_date("ts_start").alias("d")).collect()] == [
        dt.date(2026, 1, 7)]
    assert store.upsert_traces(rows.limit(0), path) == [] and store.read_traces(spark, path).count() == 302


def test_upsert_reads_ids_before_it_rewrites(spark, tmp_path, monkeypatch):
    """A day that only the filters name, by mistake, keeps its files; one that holds an id is rewritten."""
    path = str(tmp_path / "table")
    some = traces(spark, tmp_path, "a", [line(1, trace_id=uid(1))])
    row = some.first().asDict()

    def rows(*places):
        return spark.createDataFrame([{**row, "trace_id": uid(i), "ts_start": dt.datetime(2026, 1, d, 12)} for i, d in places], some.schema)

    store.write_traces(rows(*((i, 1 + i % 3) for i in range(30))), path)
    before = {d: files(path, d) for d in (1, 2, 3)}
    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    monkeypatch.setattr(store, "touched_days", lambda new, index: days)
    assert store.upsert_traces(rows((50, 1)), path) == []
    assert set(before[1]) < set(files(path, 1)) and all(files(path, d) == before[d] for d in (2, 3))
    moved = rows((1, 3), (60, 3))  # the first moves from the second day
    assert store.upsert_traces(moved, path) == [dt.date(2026, 1, 2)]
    assert set(before[3]) < set(files(path, 3)) and not set(before[2]) & set(files(path, 2))
    assert sorted(r["trace_id"] for r in store.read_traces(spark, path).select("trace_id").collect()) == sorted(
        map(uid, [*range(30), 50, 60]))


def test_latest(spark, tmp_path):
    rows = traces(spark, tmp_path, "a", [line(1, trace_id=uid(1), cost_usd=str(k)) for k in (1, 3, 2)]).withColumn(
        "seq", F.col("cost_usd").cast("int"))
    got = store.latest(rows, "seq").collect()
    assert len(got) == 1 and float(got[0]["cost_usd"]) == 3


def test_live_ingest_loses_nothing(spark, tmp_path):
    """Copies in one file, in two files and on two days keep their cost; bad lines are counted; given ids replace."""
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    same = line(1)

    def run():
        flows.stream_traces(spark, source, out, ckpt, "t", "salt", max_files=1, availableNow=True).awaitTermination()
        kept = store.read_traces(spark, f"{out}/traces").collect()
        bad = spark.read.parquet(f"{out}/rejects").collect()
        return kept, sorted((r["line"], r["place"].split("/")[-1]) for r in bad)

    put(source, "one.jsonl", [same, same, "{broken", line(2, trace_id=uid(2))])
    put(source, "two.jsonl", [same, "", "{broken"])
    kept, bad = run()
    assert len(kept) == 4 and len({r["trace_id"] for r in kept}) == 4
    assert bad == [("{broken", "one.jsonl#2"), ("{broken", "two.jsonl#2")]
    put(source, "three.jsonl", [same, line(1, 2), line(2, trace_id=uid(2), cost_usd="7")])
    kept, bad = run()
    assert len(kept) == 6 and sum(float(r["cost_usd"]) for r in kept) == 5 * 0.5 + 7 and len(bad) == 2
    batch = events.ingest(events.read_lines(spark, source), "t", "salt")[0].select("trace_id").collect()
    assert {r["trace_id"] for r in batch} == {r["trace_id"] for r in kept}
