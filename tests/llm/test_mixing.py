"""The exponent's goal, the budgets, and corner cases of the mix."""

import math

import pytest
from pyspark.sql import functions as F

from winledger.llm import mixing


def corpus(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"s{i % 5}", "x") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def test_repeats_and_budget(spark):
    docs = corpus(spark)
    drawn = mixing.mix(docs, budget=9000, repeats=1.5, block_docs=40)
    has = {r[0]: r[1] for r in mixing.token_counts(docs).groupBy("_source").agg(F.sum("tokens")).collect()}
    total, used = sum(has.values()), {r[0]: r[1] for r in drawn.groupBy("source").agg(F.sum("n_tokens")).collect()}
    over = {s: used[s] / has[s] for s in has}
    assert max(over.values()) <= 1.5 and max(over.values()) > 1.4
    assert 9000 - len(has) * 13 <= sum(used.values()) <= 9000
    assert used["big"] / sum(used.values()) < has["big"] / total
    again = [tuple(r) for r in mixing.mix(docs.repartition(7), budget=9000, repeats=1.5, block_docs=40).collect()]
    assert sorted(again) == sorted(tuple(r) for r in drawn.collect())
    whole = drawn.groupBy("source", "epoch").agg(F.countDistinct("doc_id").alias("d"), F.count("*").alias("n"))
    assert whole.where("d <> n").count() == 0


def test_entropy(spark):
    p = [0.5, 0.3, 0.15, 0.05]
    shares = spark.createDataFrame([(x,) for x in p], "p double")
    a = mixing.exponent(shares, 1.0, repeats=None, entropy=0.9)
    w = [x**a for x in p]
    w = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in w) / math.log(4) - 0.9) < 1e-6


@pytest.mark.parametrize("rows", [
    [], [(1, None, "a"), (2, "", "a")],
    [(1, "x y", None), (1, "x y", None), (None, "z", "a"), (2, "q " * 50_000, "b"), (3, None, "b")]])
def test_corners(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS epoch", "2 AS has")
    got = mixing.mix(docs, repeats=3.0)
    assert got.columns == ["doc_id", "source", "n_tokens", "epoch", "block_rank", "doc_rank"]
    assert all(r.n_tokens > 0 for r in got.collect())
    with pytest.raises(ValueError):
        mixing.mix(docs, repeats=None)
