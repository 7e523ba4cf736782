"""Repeated byte strings against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from winledger.llm import suffixes, windows


def plain(docs, length):
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p:p + length]] < i:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, length):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS doc", "2 AS start", "3 AS length", "4 AS print")
    read = suffixes.opened(frame, "doc_id", "text", [])
    got = suffixes.without(frame, read, suffixes.repeats(frame, read, length=length), "doc_id", [],
                           "n_bytes long, n_removed long, n_spans long, kept_sha256 string", suffixes._digest)
    return sorted([tuple(r) for r in got.collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randrange(40, 900))) for _ in range(25)]
    docs = list(enumerate(base))
    for i in range(25, 120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(base)
            a = rng.randrange(len(s))
            parts.append(s[a:a + rng.randrange(30, 200)])
            parts.append("".join(rng.choice("abcde") for _ in range(rng.randrange(30))))
        docs.append((i, "".join(parts)))
    docs += [(200 + i, base[3]) for i in range(20)] + [(300, "=" * 400), (301, "=" * 90 + "x" + "=" * 60)]
    docs += [(302, "abcabc " * 60), (303, "z" + "abcabc " * 40), (304, None), (305, ""), (None, base[4]),
             (4, base[5]), (4, base[4]), (306, "é" * 100), (307, "x" + "é" * 100)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("together", [1 << 13, 3])
def test_against_plain(spark, monkeypatch, together):
    monkeypatch.setattr(suffixes, "SORTED_TOGETHER", together)
    docs = corpus(together)
    assert run(spark, docs, 50) == plain(docs, 50)


def test_small_runs(monkeypatch):
    """Crowds, copies inside a run and slices of long texts, without Spark."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 5000).astype(np.uint8)
    letters = windows._BYTE[text]
    whole = windows.anchored([letters], 50, 20)
    assert whole.count.sum() == 5000 - 49 and whole.lead.min() >= 0 and whole.count.max() <= 31
    monkeypatch.setattr(windows, "SLICE", 700)
    covered = np.concatenate([at + np.arange(len(p) - 49) for at, p in windows.slices(letters, 50)])
    assert (np.sort(covered) == np.arange(5000 - 49)).all()


def test_empty(spark):
    assert run(spark, [], 50) == []


def test_dedupe_keeps_characters(spark):
    docs = [(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, "é" * 60), (4, None), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS _kept2")
    got = {r.doc_id: r.text for r in suffixes.dedupe(frame).collect()}
    assert got == {1: "é" * 60, 2: "xy", 4: None, 5: ""}


def test_rows_of_one_id(spark):
    """Texts of one id whose hashes share 16 bits are not cut alike, and a repeated row is searched once."""
    import xxhash

    from winledger.llm import suffixes
    first = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(80))
    seen, pair = {}, None
    for i in range(5000):
        for kind, text in (("copy", first + f"copy{i}"), ("other", f"own{i} " * 14)):
            low = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFF
            if pair is None and (1 - (kind == "copy"), low) in seen:
                pair = (text, seen[(1 - (kind == "copy"), low)])
            seen[(int(kind == "copy"), low)] = text
    one, two = pair
    rows = [(1, first), (5, one), (5, two)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text for r in suffixes.dedupe(frame).collect()}
    other = two if one.startswith(first) else one
    assert other in got and first in got
    many = spark.createDataFrame(rows + [(5, one), (5, two)] * 20, "doc_id long, text string")
    spans = [suffixes.repeats(f, suffixes.opened(f, "doc_id", "text", [])).count() for f in (frame, many)]
    assert spans[0] == spans[1] > 0
    assert suffixes.dedupe(many).count() == len(rows) + 40


def test_clashing_columns(spark):
    """Columns named as the operator's own come back with their values."""
    same = "the very same string of more than fifty bytes in two documents "
    rows = [(1, same + "one", "k", 1, 2, True, 3), (2, same + "two", "l", 4, 5, False, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _bytes long, _doc long, _without boolean, _own0 int")
    got = suffixes.dedupe(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "two", *rows[1][2:])]
