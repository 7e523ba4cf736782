"""Passages found by the shift tables against a plain search."""

import random
import re

import pytest

from winledger.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window):
    out = []
    for i, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item, itext in items:
            w = plain_words(itext)
            size = min(window, len(w))
            if itext is None or not size:
                continue
            for a in range(len(w) - size + 1):
                for p in range(len(words) - size + 1):
                    if words[p:p + size] == w[a:a + size]:
                        hit.update(range(p, p + size))
                        ids |= {item} - {None}  # an item without an id marks words only
        out.append((i, len(words), len(hit), sorted(ids)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS spans")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    rows = dec.find_passages(d, b, **more).collect()
    return sorted([(r.doc_id, r.n_words, sum(s.words for s in r.spans), list(r.items)) for r in rows], key=str)


@pytest.mark.parametrize("passes", [4 << 20, 200])
def test_against_plain(spark, passes):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["a", "B", "c9", "é", "x-y", "d.\n"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 5, 8, 20]))) for i in range(12) if i != 2] + [
        (30, None), (None, "a b c"), (31, ""), (5, "zz yy xx ww vv")]
    docs = [(i, make(rng.randrange(60))) for i in range(40)] + [
        (3, "zz yy xx ww vv"), (90, None), (91, ""), (91, ""), (None, items[4][1]), (92, "q " * 30000 + "zz YY xx; ww vv")]
    items = [x for x in items if x[0] is None or len(plain_words(x[1])) != 1]
    assert run(spark, docs, items, window=5, item_bytes=passes) == plain(docs, items, 5)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


@pytest.mark.parametrize("passes", [4 << 20, 60])
def test_clean_rows(spark, passes):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "x " + item), (1, "other"), (2, "other"), (None, "q"), (3, None), (4, "y " + item.replace("w", "v"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (None, item.replace("w", "v"))], "item_id long, text string")
    got = dec.clean_rows(d, b, item_bytes=passes)
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 3] and got.columns == d.columns
