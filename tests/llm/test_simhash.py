"""Fingerprints and components against brute force."""

import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from winledger.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else \
        [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c x", max_size=60))
def test_print(text):
    got = simhash.majority_bits([simhash.shingle_hashes(text.encode(), 3)])
    assert int(got[0]) == plain_print(text)


def test_groups(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = docs[5][1]
    docs += [(10_000 + i, base + " w" * i) for i in range(30)] + [(20_000, None), (20_001, ""), (20_002, " \n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text")
    frame = frame.selectExpr("doc_id", "text", "1 AS fingerprint", "2 AS key", "3 AS root", "4 AS component_id")
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_groups(frame).collect()}
    prints = {i: plain_print(t) for i, t in docs}
    roots = plain_components(prints)
    assert got == {i: (prints[i], roots[i]) for i in prints}
    assert len(set(roots.values())) < len(roots)


def test_links_lose_no_pair(spark, monkeypatch):
    """Every distance up to three, in all places; with small tiles as well."""
    import itertools
    import random

    random.seed(1)
    monkeypatch.setattr(simhash, "TILE", 4)
    values = {0}
    for n in (1, 2, 3):
        for bits in random.sample(list(itertools.combinations(range(64), n)), 40):
            values.add(sum(1 << b for b in bits) ^ 0x5555AAAA12345678)
    values |= {random.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint long")
    links = simhash.close_links(frame).collect()
    root = {v: v for v in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        x, y = find(a % 2**64), find(b % 2**64)
        assert bin((a % 2**64) ^ (b % 2**64)).count("1") or x == y
        root[max(x, y)] = min(x, y)
    want = plain_components({v: v for v in values})
    mine = {v: find(v) for v in values}
    assert len({(want[v], mine[v]) for v in values}) == len(set(want.values())) == len(set(mine.values()))


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (1, None), (1, "a b c d"), (1, "a b c d")]])
def test_corners(spark, rows):
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
