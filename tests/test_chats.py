"""Branches of large and broken chat trees; log files read in blocks."""

import json
import random

from pyspark.sql import functions as F

from winledger.sources import chats

NODES = "conv_id string, node string, parent string, current string"


def walked(nodes):
    """(conv, node, steps above) by following parents one by one."""
    out = []
    for conv in {c for c, *_ in nodes}:
        tree = {n: p for c, n, p, _ in nodes if c == conv}
        at, seen = next(x for c, _, _, x in nodes if c == conv), []
        while at in tree and at not in seen:
            seen.append(at)
            at = tree[at]
        out += [(conv, n, k) for k, n in enumerate(seen)]
    return sorted(out)


def test_branches(spark):
    rng = random.Random(5)
    nodes = [("one", "a", None, "a"), ("loop", "x", "z", "y"), ("loop", "y", "x", "y"), ("loop", "z", "y", "y"),
             ("self", "s", "s", "s"), ("gone", "g", "missing", "g"), ("none", "n", None, "elsewhere")]
    for c in range(20):
        size = rng.randrange(2, 60)
        parents = [None, *(rng.randrange(k) for k in range(1, size))]
        if c % 3 == 0:
            parents[0] = rng.randrange(size)
        nodes += [(f"c{c}", f"n{k}", None if p is None else f"n{p}", f"n{size - 1}") for k, p in enumerate(parents)]
    got = chats.branches(spark.createDataFrame(nodes, NODES)).collect()
    assert sorted(map(tuple, got)) == walked(nodes)


def test_long_branch(spark):
    """A hundred thousand nodes, two thirds of them in a row, in as many rounds as that number has binary digits."""
    n = F.col("id")
    nodes = spark.range(100_000).select(
        F.lit("c").alias("conv_id"), n.cast("string").alias("node"),
        F.when(n % 3 == 2, n - 1).when(n % 3 == 1, n - 1).otherwise(F.nullif(n, F.lit(0)) - 2).cast("string").alias("parent"),
        F.lit("99999").alias("current"))
    got = chats.branches(nodes).agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("m"), F.countDistinct("node").alias("d")).head()
    assert (got["n"], got["m"], got["d"]) == (66_667, 66_666, 66_667)


def test_log_in_blocks(sliced, tmp_path):
    """One file of many blocks and slices gives the turns of the whole."""
    spark, rng, lines = sliced, random.Random(2), ['{"type":"summary","summary":"T"}']
    for i in range(400):
        kind = rng.choice(["user", "assistant"])
        content = [{"type": "tool_result", "content": f"r{i}"}] if kind == "user" and rng.random() < 0.6 else f"says {i}"
        lines.append(json.dumps({"type": kind, "cwd": "/w/p", "timestamp": "2026-01-02T00:00:00Z", "message": {"content": content}}))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "s.jsonl").write_text("\n".join(lines))
    (tmp_path / "talk").mkdir()
    talk = "\n".join(["preface", *(f"{rng.choice(['User', 'Bot'])}: line {i}\nmore {i}" for i in range(300))])
    (tmp_path / "talk" / "t.md").write_text(talk)
    (tmp_path / "talk" / "notes.md").write_text("plain\n\nnotes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = chats.read_lines(spark, str(tmp_path / "logs"))
        assert read.rdd.getNumPartitions() > 5
        turns, heads = chats.read_session_logs(spark, str(tmp_path / "logs"))
        got = sorted((r["turn"], r["role"], r["content"]) for r in turns.collect())
        assert heads.head()["title"] == "T" and heads.head()["project"] == "p"
        told = sorted((r["conv_id"].split("/")[-1], r["turn"], r["role"], r["content"])
                      for r in chats.read_transcripts(spark, str(tmp_path / "talk")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.winledger.sliceRows", str(1 << 40))
    whole = spark.createDataFrame([("/x/s.jsonl", "\n".join(lines))], "path string, text string")
    assert got == sorted((r["turn"], r["role"], r["content"]) for r in chats.parse_session_logs(whole)[0].collect())
    assert len(got) > 100
    texts = spark.createDataFrame([("t.md", talk), ("notes.md", "plain\n\nnotes")], "path string, text string")
    assert told == sorted(tuple(r) for r in chats.parse_transcripts(texts).collect())
