"""The filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np

from winledger.llm import audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, part string, n long"


def plain(rows, labels):
    """(part, order, step) -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    facts = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        facts.append((i, lang or "", {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}))
    out = {}
    for part in {p for _, p, _ in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [x for x in facts if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[2][f]]
                redundant = sum(x[2][f] for x in gone)
                gone += removed
                left = [x for x in left if not x[2][f]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), redundant,
                    sum(x[2][f] and sum(x[2].values()) == 1 for x in facts if x[1] == part),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_against_plain(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        n = rng.choice([0, 3, 99, 100, 101, 140])
        pool = [f"w{k}" for k in range(rng.choice([60, 80, 200]))]
        text = " ".join(rng.choice(pool) if rng.random() < 0.9 else "ABC" * rng.randrange(1, 9) for _ in range(n))
        if rng.random() < 0.2:
            text += rng.choice(" #$%&*|\t\x0b")
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(5, rows[5][1], "de"), (5, rows[5][1], "de"), (7, "other", "en"), (None, "other", "en"), (None, "other", "en"),
             (900, None, "fr"), (901, "", "fr"), (902, "x y " * 200_000, "fr"), (903, " ", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, 9, "z", 8) for i, t, lang in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.filter_audit(docs, marks).collect()}
    want = plain(rows, labels)
    assert len(want) == 4 * 600
    assert got == want


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = audit.op11_filter_audit(spark, sf_dir)
    want = con.sql(audit.SQL).fetchall()
    assert [c[0] for c in con.sql(audit.SQL).description] == frame.columns
    assert sorted(tuple(r) for r in frame.collect()) == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_contraction_is_the_sum():
    tensor = np.random.default_rng(1).integers(0, 9, (3, 2, 2, 2, 2, 2))
    rows = audit.audited(tensor)
    row = rows[(rows.filter_order == "CAEBD") & (rows.step == 3)].iloc[0]
    assert row.removed == tensor[0, 0, :, 0, :, 1].sum()
    assert row.kept == tensor[0, 0, :, 0, :, 0].sum()
