"""Near copies of the pipeline against all pairs compared plainly."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from winledger.llm import nearcopies as nc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots_of(docs):
    root = {i: i for i, _ in docs}
    sets = [(i, shingles(t or "")) for i, t in docs]
    for i, a in sets:
        for j, b in sets:
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_planted(spark):
    """Copies with a few words changed, added or cut, far over three bits apart, and a crowd of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfglmnprstaeiou") for _ in range(6))
    docs = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(60, 250))]
        docs.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            for _ in range(rng.randrange(1, 7)):
                w[rng.randrange(len(w))] = word()
            docs.append((10 * i + k, " ".join(w + [word() for _ in range(rng.randrange(3))])))
    base = [word() for _ in range(200)]
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = word()
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000, None), (2001, "  "), (2002, "one two"), (2003, "One  TWO"), (2004, "one two three")]
    root = roots_of(docs)
    want = {i for i, r in root.items() if i == r}
    assert len(want) < len(docs) - 200
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert nc.representatives(frame.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Columns named as the operator's own come back with their values."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 11, 12, 13, "a"), (2, text, 21, 22, 23, "b"), (3, "other words", 31, 32, 33, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n1 int, _n2 int, _nth int, _own0 string")
    got = nc.representatives(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def _prints(rng, n):
    return rng.integers(0, 1 << 63, (n, len(nc.PRINT)), np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, len(nc.PRINT)), np.uint64)


def test_prints():
    """Prints of sets alike at 0.8 are close, and share a block; those of other sets are not close."""
    rng, far, missed = np.random.default_rng(7), 0, 0
    places = nc.blocks(100_000)
    for n in (20, 60, 300, 5000):
        for _ in range(50):
            both = rng.integers(0, 1 << 63, n, np.uint64)
            own = [rng.integers(0, 1 << 63, n // 8, np.uint64) for _ in range(2)]
            x, y = (nc.long_print(np.concatenate((both, o))) for o in own)
            other = nc.long_print(rng.integers(0, 1 << 63, n, np.uint64))
            far += np.bitwise_count(x ^ y).sum(dtype=int) > nc.MOST
            missed += not (nc.block_keys(x[None], places) == nc.block_keys(y[None], places)).any()
            assert np.bitwise_count(x ^ other).sum(dtype=int) > nc.MOST
    assert far == 0 and missed <= 1


def test_candidates_against_all_pairs(spark, monkeypatch):
    """Groups by blocks, with and without crowds and tiles, against every pair of prints."""
    rng = np.random.default_rng(3)
    prints = _prints(rng, 60)
    flips = lambda p, n: p ^ np.packbits(
        np.isin(np.arange(nc.BITS), rng.choice(nc.BITS, n, replace=False)), bitorder="little").view("<u8")
    prints = np.array([*prints, *(flips(prints[0], rng.integers(1, 30)) for _ in range(150)),
                       *(flips(prints[i], 40) for i in range(1, 20))])
    root = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in np.nonzero(np.bitwise_count(prints[:i] ^ p).sum(axis=1, dtype=int) <= nc.MOST)[0]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    frame = spark.createDataFrame([(i, *map(int, p.view(np.int64))) for i, p in enumerate(prints)],
                                  "node long, " + ", ".join(f"{p} long" for p in nc.PRINT))
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert len(want) == 151 + 2 * 19
    for crowd, tile in ((4096, 1024), (20, 16)):
        monkeypatch.setattr(nc, "CROWD", crowd)
        monkeypatch.setattr(nc, "TILE", tile)
        assert {r.node: r.root for r in nc.components(nc.candidates(frame), "a", "b").collect()} == want


def test_marked_texts(spark):
    """Wanted texts pass with all their copies, and few others; with many wanted for the bits, more pass, none is lost."""
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS _h", "cast(id AS string) AS _text")
    wanted = rows.where("cast(_text AS long) % 40 = 0").select(F.col("_text").cast("long").alias("node"), F.col("_h").alias("_hash"))
    got = {r["_text"] for r in nc._marked(rows.unionByName(rows), wanted).collect()}
    assert {str(i) for i in range(0, 20_000, 40)} <= got and len(got) < 2500
    assert nc._marked(rows.unionByName(rows), wanted).join(wanted, F.col("_h") == F.col("_hash")).count() == 1000
    assert nc._marked(rows, wanted.limit(0)).count() == 0


def test_prints_are_shuffled_once(spark):
    """Without a block of over ``CROWD`` nodes the prints are neither joined with counts nor copied for tiles."""
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, *map(int, p.view(np.int64))) for i, p in enumerate(_prints(rng, 50))],
                                  "node long, " + ", ".join(f"{p} long" for p in nc.PRINT))
    plan = nc.candidates(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1
