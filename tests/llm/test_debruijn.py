"""Repeated word windows against a table of all windows."""

import hashlib
import random

from pyspark.sql import functions as F

from winledger.llm import debruijn
from winledger.llm.suffixes import opened, without


def plain(docs, size):
    least, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - size + 1):
                k = tuple(w[p:p + size])
                least[k] = min(least.get(k, i), i)
    for i, w in split:
        gone, seen = set(), set()
        for p in range(len(w) - size + 1) if i is not None else ():
            k = tuple(w[p:p + size])
            if least[k] < i or k in seen:
                gone.update(range(p, p + size))
            seen.add(k)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "x", "é", "\x1c"])
    base = [[word() for _ in range(rng.randrange(10, 200))] for _ in range(20)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(20, 90):
        w = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(base)
            a = rng.randrange(len(s))
            w += s[a:a + rng.randrange(10, 70)] + [word() for _ in range(rng.randrange(6))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    docs += [(200 + i, docs[7][1]) for i in range(15)] + [(300, "la " * 200), (301, "la " * 60 + "lo " + "la " * 30)]
    docs += [(302, "p q r " * 50), (303, None), (304, ""), (305, " \n "), (None, docs[3][1]), (4, docs[5][1]),
             (4, docs[4][1]), (6, docs[6][1])]
    rng.shuffle(docs)
    return docs


def test_against_plain(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS count", "3 AS doc")
    read = opened(frame, "doc_id", "text", [])
    spans = debruijn.passages(frame, read).select(
        "doc", "print", "start", (F.col("count") + 19).cast("long").alias("length"))
    got = without(frame, read, spans, "doc_id", [], "n_words long, n_removed long, kept_sha256 string",
                  debruijn._digest(20))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(docs, 20)


def test_paths_are_compacted_and_copied_as_they_stand(spark):
    base = " ".join(f"w{i}" for i in range(300))
    docs = [(1, base), (2, "x y z " + base + " q"), (3, base[: len(base) // 2])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = debruijn.passages(frame, opened(frame, "doc_id", "text", [])).orderBy("doc").collect()
    words = {i: t.split() for i, t in docs}
    assert len(rows) <= 6
    for r in rows:
        n = r["count"] + 19
        assert words[r.doc][r.start:r.start + n] == words[r.from_doc][r.from_start:r.from_start + n]
    assert sum(r["count"] for r in rows if r.doc == 2) == 300 - 19


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert debruijn.passages(frame, opened(frame, "doc_id", "text", [])).count() == 0
