"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from winledger.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def documents():
    rng = random.Random(8)
    letters = "abcdeéüÀÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    bases += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "strasse", "Strasse", "a×bcdefgh"]
    words = []
    for k, base in enumerate(bases):
        words += [base] * (400 if k % 3 == 0 else 30)
        for _ in range(12):
            at, how = rng.randrange(len(base)), rng.randrange(4)
            new = (base[:at] + rng.choice(letters) + base[at + (how > 0):] if how < 3 else base[:at] + base[at + 1:])
            words += [new] * rng.choice([1, 2, 3, 30])
            if how == 1:
                words += [new[1:] + new[0]] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]).replace("e e", "e.E") + "; x-y 12") for i in range(40)]
    return rows + [(1, None), (2, ""), (None, " ".join(words[:80])), (7, rows[7][1]), (7, rows[7][1]), (9, "z" * 100_000),
                   (10, "y" * 400 + " " + "y" * 400 + " " + "y" * 401 + " " + "y" * 401)]


def test_against_plain(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want


def test_tiles(spark, monkeypatch):
    """A crowded key in tiles gives the same rows."""
    rng = random.Random(2)
    words = sorted({"prefixx" + "".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
    frame = spark.createDataFrame([(w, 2 + k % 5) for k, w in enumerate(words)], "word string, n long")
    whole = sorted(map(str, spelling.near_words(frame).collect()))
    monkeypatch.setattr(spelling, "TILE", 4)
    assert sorted(map(str, spelling.near_words(frame).collect())) == whole
    near = {w: sum(one_edit(v, w) for v in words if abs(len(v) - len(w)) < 2) for w in words}
    got = {r.word: r.n_near for r in spelling.near_words(frame).collect()}
    assert got == {w: n for w, n in near.items() if n}


def test_gram_distances():
    words = ["abcdefg", "abcdefgh", "gfedcba", "abcdxyz", "éüabcde"]
    counts = spelling.letter_counts(words)
    want = ((counts[:, None] - counts[None]) ** 2).sum(axis=2) <= 2
    x, y = spelling.close_pairs(counts, counts)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(want)), strict=True))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(spelling.SQL).fetchall()
    got = spelling.op13_spelling_variants(spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
