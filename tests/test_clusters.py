"""The density hierarchy, and merging many labels."""

import random

import numpy as np
import pytest

from winledger.operators import cluster
from winledger.plans.graph import components

SCHEMA = ("tenant_id string, task_id string, template string, tool_sig string, out_type string, json_valid boolean, "
          "has_code boolean, len double")


def frame(spark, rows):
    return spark.createDataFrame([("x", str(i), t, s, o, o == "json", o == "code", n) for i, (t, s, o, n) in enumerate(rows)], SCHEMA)


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, None), (None, 8), (200, 100)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    want = {x: x for a, b in edges if a is not None and b is not None for x in (a, b)}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                want[a] = want[b] = min(want[a], want[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_clusters_of_different_density(spark):
    """One bound for all would find the dense cells only, or break the sparse group up with a lower one."""
    dense = [("A", "x", "text", 0.3)] * 200
    sparse = [("B", f"tools{i}", "text", 0.5) for i in range(300)]  # every task has tools of its own
    nested = [("C", "y", "text", 0.2)] * 60 + [("C", "z", "json", 0.7)] * 60 + [("C", f"other{i}", "code", 0.4) for i in range(100)]
    stray = [("D", "x", "text", 0.31), ("E", "z", "json", 0.7)]
    rows = frame(spark, dense + sparse + nested + stray)
    got = cluster.density_clusters(rows, min_size=50).collect()
    assert len(got) == 722
    label = {(r["template"], r["tool_sig"][:5]): r["label"] for r in got}
    assert {r["label"] for r in got} == {1, 2, 3, 4, 5}
    assert label["B", "tools"] == 1 and label["A", "x"] == 2 and label["C", "other"] == 3
    assert {label["C", "y"], label["C", "z"]} == {4, 5}  # inside template C, as is the sparse group of its code
    assert all(len({r["label"] for r in got if r["template"] == t and r["out_type"] == o}) == 1
               for t, o in (("B", "text"), ("C", "code")))
    assert label["D", "x"] == 2 and label["E", "z"] == label["C", "z"]  # the nearest centroids
    by_cell = [r["count"] for r in rows.groupBy(*cluster.CELL).count().collect()]
    assert sum(n >= 50 for n in by_cell) == 3 and max(n for n in by_cell if n < 50) == 1


def test_few_tasks_go_by_template(spark):
    """With no more tasks than the least size there is nothing to be dense, as with no branch."""
    rows = [("a", "x", "text", 0.1)] * 3 + [("b", "x", "text", 0.1)] * 2
    got = cluster.density_clusters(frame(spark, rows)).collect()
    assert sorted((r["template"], r["label"]) for r in got) == [("a", 1)] * 3 + [("b", 2)] * 2
    assert cluster.density_clusters(frame(spark, [])).count() == 0


def test_null_categories(spark):
    rows = [(None, "x", "text", 0.1)] * 8 + [("b", "x", None, 0.1)] * 8
    got = cluster.density_clusters(frame(spark, rows)).groupBy("template", "label").count().collect()
    assert sorted((r["template"] or "", r["label"], r["count"]) for r in got) == [("", 1, 8), ("b", 2, 8)]


def test_too_many_branches(spark, monkeypatch):
    monkeypatch.setattr(cluster, "NODES", 3)
    rows = frame(spark, [(f"t{i % 5}", "x", "text", 0.1) for i in range(50)])
    with pytest.raises(ValueError, match="branches"):
        cluster.density_clusters(rows, min_size=2)


def test_ten_thousand_labels(spark):
    """Prompts that hold variables: each template once. The labels stay tables; no task is lost."""
    rows = frame(spark, [(f"t{i}", f"s{i % 7}", ("text", "json", "code")[i % 3], i % 10 / 10) for i in range(10_000)])
    labelled = rows.withColumn("label", rows["task_id"].cast("int") + 1)
    merged = cluster.merge_clusters(labelled)
    sizes = merged.groupBy("label").count().collect()
    assert len(sizes) == cluster.TARGET and sum(r["count"] for r in sizes) == 10_000
    assert merged.columns == labelled.columns


def test_small_labels_join_the_nearest_large_one(spark):
    """Against centroids as vectors; one value is on half of the tasks."""
    rng = random.Random(9)
    rows = [(f"t{rng.randrange(30)}", rng.choice(["s", "s", "s1", "s2"]), rng.choice(["text", "json"]), rng.random())
            for _ in range(600)]
    of = [int(rng.expovariate(0.08)) for _ in rows]
    labelled = frame(spark, rows).withColumn("label", cluster.F.element_at(cluster.F.array(*map(cluster.F.lit, of)),
                                                                         cluster.F.col("task_id").cast("int") + 1))
    cells = labelled.groupBy("label", *cluster.CELL).agg(cluster.F.count("*").alias("n"), cluster.F.sum("len").alias("len_sum"))
    got = {r["label"]: r["into"] for r in cluster.attach_small(cells, kept=6).collect()}
    values = [sorted({r[k] for r in rows}) for k in range(3)]
    vectors = np.array([[w * (r[k] == v) for k, w in enumerate((3.0, 2.0, 1.0)) for v in values[k]]
                        + [r[2] == "json", r[2] == "code", r[3]] for r in rows], float)
    mid = {k: vectors[[x == k for x in of]].mean(axis=0) for k in set(of)}
    large = sorted(mid, key=lambda k: (-of.count(k), k))[:6]
    want = {k: k if k in large else min(large, key=lambda b: (round(float(((mid[k] - mid[b]) ** 2).sum()), 9), b)) for k in mid}
    assert got == want
