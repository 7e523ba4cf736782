"""The label model and classifier on made-up texts, and held-out accuracy on the test tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from winledger.llm import toxicity as tox


def made(n, seed=0):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ze") for b in ("ran", "dol", "vis", "mek", "sup", "hin")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        bad = rng.random() < 0.15
        if bad:
            words += rng.choices(["grumbo", "snark", "fleeble", "bratling"], k=rng.randrange(3, 8))
        elif rng.random() < 0.05:
            words.append("grumbo")
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad) if rng.random() > 0.01 else int(not bad)))
    return rows


def test_made_up(spark):
    rows = made(1500)
    frame = spark.createDataFrame(rows, "_id long, _text string, _label int")
    model = tox.train(frame)
    assert {"grumbo", "snark", "fleeble", "bratling"} <= {e for e, _, _ in model.lexicon}
    fresh = made(800, seed=9)
    got = model.scores([t for _, t, _ in fresh]) >= tox.THRESHOLD
    assert (got == np.array([y for _, _, y in fresh])).mean() > 0.97
    empty = model.scores(["", "kadol " * 30_000])
    assert (empty >= 0).all() and (empty < tox.THRESHOLD).all()


def test_label_model_discounts_copies():
    """Ten copies of a weak voter cost little against the best any rule does with one copy."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [(rng.random(4000) < np.where(y, 0.8, 0.05)) for _ in range(3)]
    weak = rng.random(4000) < np.where(y, 0.5, 0.3)
    ballots = np.stack(good + [weak] * 10, axis=1).astype(np.float32)
    seen = np.where(rng.random(4000) < 0.3, ~y, y)
    got = tox.label_model(ballots, seen.astype(int), noise=0.3) > 0.5
    lor = lambda v, a, b: np.where(v, np.log(a / b), np.log((1 - a) / (1 - b)))
    told = sum(lor(g, 0.8, 0.05) for g in good) + lor(weak, 0.5, 0.3) + lor(seen, 0.7, 0.3) + np.log(0.3 / 0.7)
    best = ((told > 0) == y).mean()
    assert (got == y).mean() > best - 0.01


def test_corners(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")],
                                 "doc_id long, text string, score string")
    for labels in ([], [(1, 1, None), (2, None, None), (2, 1, 0), (None, 1, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = tox.fitted(docs, frame)
        assert tox.score(docs, model).count() == 4
        assert tox.clean_rows(docs, model).columns == docs.columns
    assert tox.score(docs.limit(0), model).count() == 0


def test_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    scored = tox.score(docs, tox.fitted(docs, labels)).join(labels, "doc_id").where(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    told = scored.select((F.col("score") >= 0.7).cast("int").alias("p"), "toxic").toPandas()
    assert ((told.p == 1) & (told.toxic == 0)).sum() <= 0.01 * len(told)
    assert ((told.p == 1) & (told.toxic == 1)).sum() >= 0.85 * told.toxic.sum()
