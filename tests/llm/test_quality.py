"""Gradients, passages and held-out accuracy of the quality classifier."""

import numpy as np
from pyspark.sql import functions as F

from winledger.llm import quality as q


def test_gradients():
    rng = np.random.default_rng(0)
    counts = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    model = q.fit(x, counts, y, epochs=1)
    model.weights["out"] = rng.normal(size=q.HIDDEN)

    def loss():
        s = model.scores(x, counts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()
    for k, g in model.gradients(x, counts, y).items():
        w = model.weights[k]
        for at in list(np.ndindex(w.shape))[:5]:
            held = w[at].copy()
            w[at] = held + 1e-5
            up = loss()
            w[at] = held - 1e-5
            down = loss()
            w[at] = held
            assert abs((up - down) / 2e-5 - np.asarray(g)[at]) < 1e-6


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 600)
    x = rng.normal(size=(counts.sum(), 4))
    y = rng.random(600) < 0.5
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    bad = begin + rng.integers(0, counts)
    x[bad[~y], 0] += 6
    model = q.fit(x, counts, y.astype(float), epochs=30)
    f = model.forward(x, counts)
    assert ((f["score"] > 0.5) == y).mean() > 0.95
    several = ~y & (counts > 2)
    assert (f["a"][bad[several]] > 1 / counts[several]).mean() > 0.8


def test_passages():
    texts = [b"", b"one", b"w " * 200, "É a".encode(), b" \n "]
    x, counts = q.passages(texts)
    assert counts.tolist() == [1, 1, 4, 1, 1] and np.isfinite(x).all() and len(x) == 8
    for i, t in enumerate(texts):
        alone, _ = q.passages([t])
        at = counts[:i].sum()
        assert np.allclose(alone, x[at:at + counts[i]])


def test_corners(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "a b", 2.0), (2, "", 3.0), (2, "x " * 90_000, 4.0)],
                                 "doc_id long, text string, score double")
    for labels in ([], [(1, 1, None), (2, None, 0), (None, 1, 1)]):
        model = q.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        rows = q.score(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert q.score(docs.limit(0), model).count() == 0


def test_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    told = q.score(docs, q.fitted(docs, labels)).join(labels, "doc_id").where(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select((F.col("score") >= 0.3).alias("p"), "quality").toPandas()
    assert (told.p == (told.quality == 1)).mean() > 0.97
