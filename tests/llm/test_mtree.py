"""Top-k against all inner products."""

import math

import numpy as np
import pytest

from winledger.llm import mtree


def plain(rows, every, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[(i, tuple(math.floor(1024 * x) for x in v))] = None
    out = []
    for qi, q in good:
        if qi % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i)
                          for i, v in good if i != qi and len(v) == len(q))[:k]
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, every):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS node")
    return sorted(tuple(r) for r in mtree.top_k(frame, every).collect())


@pytest.mark.parametrize("sizes", [(1024, 8192, 64), (20, 30, 4)])
def test_against_plain(spark, monkeypatch, sizes):
    for name, n in zip(("NODE_ROWS", "PART_ROWS", "PAGE_ROWS"), sizes, strict=True):
        monkeypatch.setattr(mtree, name, n)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.3).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(5, [0.0] * 8), (20, rows[40][1]), (20, rows[40][1])]
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8),
             (2010, []), (None, [1.0] * 8), (2020, [1.0, 2.0]), (2021, [3.0, -1.0])]
    assert run(spark, rows, 10) == plain(rows, 10)


def test_empty(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(10, [1.0])], 10) == []


def test_pages_pass_over_entries():
    """The bound spares most products on clustered vectors and loses none of the best."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 6)) * 5000
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 6)) * 20)
    top = float((x * x).sum(axis=1).max())
    pages = mtree.Pages(np.arange(2000), x, x[0], top)
    done = []
    real = mtree._products
    mtree._products = lambda a, b: done.append(len(a)) or real(a, b)
    try:
        q = x[17:18]
        (_, scores, _), = pages.search(q, np.array([17]), np.array([np.inf]), top, 10)
    finally:
        mtree._products = real
    want = np.sort(np.delete(x @ q[0], 17))[::-1][:10]
    assert (scores == want).all() and sum(done) < 1000


def test_many_copies_tie_by_id():
    """Copies of the query, far from zero, are all at distance nothing; none may be passed over."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        one = np.floor(rng.normal(size=64) * 130)
        others = np.floor(one + rng.integers(-1, 2, size=(300, 64)) * (rng.random((300, 1)) < 0.7))
        x = np.concatenate((np.repeat(one[None], 40, axis=0), others))
        ids = rng.permutation(len(x))
        top = float((x * x).sum(axis=1).max())
        pages = mtree.Pages(ids, x, x[rng.integers(len(x))], top)
        own = ids[:1]
        (_, scores, found), = pages.search(one[None], own, np.array([0.0 if (others @ one).max() < one @ one else np.inf]),
                                           top, 10)
        best = sorted((-float(v @ one), int(i)) for v, i in zip(x, ids, strict=True) if i != own[0])[:10]
        assert [(-s, int(i)) for s, i in zip(scores, found, strict=True)] == best
