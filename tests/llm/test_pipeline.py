"""The pipeline against its stages done plainly, and what it does with planted cases."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_decontaminate import plain as plain_hits
from test_nearcopies import roots_of

from winledger.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(260):
        text = words(rng, rng.randrange(60, 160))
        bad = i % 6 == 0
        if bad:
            text += " " + " ".join(rng.choices(["snarkle", "grumbo", "bratwit"], k=5)) + " " + words(rng, 20)
        docs.append((i, text))
        labels.append((i, 1, int(bad)))
    item = words(rng, 30)
    passage = words(rng, 60)
    docs[7] = (7, docs[7][1] + " " + item)
    docs[9] = (9, words(rng, 40) + " " + passage)
    docs[13] = (13, passage + " " + words(rng, 50))
    docs += [(300, docs[1][1]), (301, docs[2][1] + " end"), (302, None), (303, "")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def plain_cut(docs, length=50):
    first = {}
    for i, t, *_ in docs:
        b = t.encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t, *rest in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        if kept or not t:
            out.append((i, kept, *rest[:-1], len(kept)))
    return out


def test_stages(spark, tables):
    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    kept = [r for r in rows if model.scores([r[1] or ""])[0] < toxicity.THRESHOLD]
    assert {r[0] for r in rows if r[0] < 260 and r[0] % 6 == 0} == {r[0] for r in rows} - {r[0] for r in kept}
    stage = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, folder)
        if k < 4:
            assert stage.columns == docs.columns
        got = sorted(tuple(r) for r in stage.collect())
        if k == 1:
            roots = roots_of([(r[0], r[1]) for r in kept])
            kept = [r for r in kept if roots[r[0]] == r[0]]
            assert not {300, 301, 303} & {r[0] for r in kept}  # two copies, a near copy, and two empty texts
        elif k == 2:
            kept = sorted(plain_cut([r for r in kept if r[1] is not None])
                          + [(*r[:-1], None) for r in kept if r[1] is None])
        elif k == 3:
            hit = {i for i, _, n, _ in plain_hits([(r[0], r[1]) for r in kept], [(1, item)], 10) if n}
            assert hit == {7}
            kept = [r for r in kept if r[0] not in hit]
        if k < 4:
            assert got == sorted(kept)
            stage = spark.createDataFrame(kept, SCHEMA)
    total = {}
    for r in kept:
        total[r[3]] = total.get(r[3], 0) + len((r[1] or "").split())
    used = {}
    for r in got:
        used[r[1]] = used.get(r[1], 0) + r[2]
    assert sum(used.values()) <= sum(total.values())
    assert all(used[s] <= mixing.REPEATS * total[s] for s in used)
    assert got == sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
