"""Class bigrams against plain counts, plain sums and the probabilities' own rules."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from winledger.llm import classlm as lm

SCHEMA = "doc_id long, text string, words string, block long, n long"


def corpus(seed=4, n=400):
    """Two languages whose sentences alternate between nouns and verbs of their own."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        tongue = "ab"[i % 2]
        words = []
        for _ in range(rng.randrange(5, 40)):
            kind = "nv"[len(words) % 2]
            words.append(f"{tongue}{kind}{int(rng.expovariate(0.05))}")
        rows.append((i, " ".join(words).replace("an1 ", "AN1\t")))
    return rows + [(400, None), (401, ""), (402, "  "), (403, "never seen"), (None, "an1 null"), (5, "an1 av2"), (5, "an1 av2"),
                   (404, "an1 av1 " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().decode().split() + [""]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


@pytest.fixture(scope="module")
def model(spark):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "BLOCK", 700)
        patch.setattr(lm, "CORE", 60)
        patch.setattr(lm, "ROUNDS", 6)
        return lm.fitted(frame(spark, corpus()))


def test_scores(spark, model):
    """Counts and the base by their definition; the score by plain sums over the classes that were found."""
    rows = corpus()
    count = Counter(t for i, text in rows if learned(i) for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    assert model.tokens == total
    kinds = {(r["word"], r["class"], r["n"]) for r in model.words.collect()}
    kind = {w: k for w, k, _ in kinds} | {"": lm.END}
    assert len(kinds) == len(kind) - 1 and all(n == count[w] for w, _, n in kinds)
    assert all((k == lm.UNKNOWN) == (n == 0) for _, k, n in kinds)
    in_class, after, seen = Counter(), Counter(), Counter()
    after_unknown, seen_unknown, once_after = Counter(), 0, Counter()
    for i, text in rows:
        if learned(i):
            before = ""
            for w in tokens(text):
                in_class[kind[w]] += 1
                after[kind[before], kind[w]] += 1
                seen[kind[before]] += 1
                once_after[kind[before]] += count[w] == 1
                if count[before] == 1 and before:
                    after_unknown[kind[w]] += 1
                    seen_unknown += 1
                    once_after[lm.UNKNOWN] += count[w] == 1
                before = w
    after |= {(lm.UNKNOWN, k): n for k, n in after_unknown.items()}
    seen[lm.UNKNOWN] = seen_unknown
    once = sum(n for k, n in once_after.items() if k != lm.UNKNOWN)

    def chance(before, k):
        unknown = (once_after[before] + 50 * (once + 0.5) / (total + 1)) / (seen[before] + 50)
        if k == lm.UNKNOWN:
            return unknown
        return (1 - unknown) * (after[before, k] + 5 * in_class[k] / total) / (seen[before] + 5)

    want = []
    for i, text in rows:
        base = score = 0
        before = lm.END
        for w in tokens(text):
            base += math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
            score += math.log10(chance(before, kind[w]) * (count[w] / in_class[kind[w]] if count[w] else 1))
            before = kind[w]
        want.append((i, len(tokens(text)), sum(count[w] > 0 for w in tokens(text)), base, score))
    got = [tuple(r) for r in lm.scored(model).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)
    for before in {*range(lm.CLASSES), lm.END, lm.UNKNOWN}:
        assert sum(chance(before, k) for k in {*in_class, lm.UNKNOWN}) == pytest.approx(1)
    fold = [r for r in got if r[0] is not None and not learned(r[0]) and r[0] < 400]
    assert sum(r[4] for r in fold) > sum(r[3] for r in fold) + 0.2 * sum(r[1] for r in fold)


def test_probabilities_sum_to_one(model):
    """Over all known words and the unknown one, after every class."""
    words = {(r["word"], r["class"], r["n"]) for r in model.words.collect() if r["n"]}
    step = model.transitions.step
    ends = 10 ** step[:, lm.END] * sum(learned(i) for i, _ in corpus())
    known = sum(10 ** step[:, k] * n for _, k, n in words)
    assert known + ends + 10 ** step[:, lm.UNKNOWN] == pytest.approx(np.ones(lm.SIDES))


def test_exchange_gains(spark):
    """The likelihood that is claimed for a single move is the one counted anew, and rounds of moves raise it."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(words[k % 3::3]) for k in range(rng.randrange(4, 30)))) for i in range(1, 80)]
    read = lm.blocks(frame(spark, rows), "doc_id", "text")
    core = {w.encode(): k for k, w in enumerate(words[:10])}
    classes = np.arange(10) % 4
    counts = lm.neighbours(read, core, classes)
    of = {w: classes[k] for k, w in enumerate(words[:10])} | {"": lm.END, "w10": lm.REST, "w11": lm.REST}
    plain = np.zeros((lm.SIDES - 1, lm.SIDES - 1))
    for i, text in rows:
        if learned(i):
            before = ""
            for w in tokens(text):
                plain[of[before], of[w]] += 1
                before = w
    assert (lm.bigrams(counts, classes) == plain).all()
    for word in range(10):
        moved = lm.exchanged(counts, classes, [word])
        best = max(lm.likelihood(lm.bigrams(lm.neighbours(read, core, np.where(np.arange(10) == word, k, classes)),
                                            np.where(np.arange(10) == word, k, classes))) for k in (0, 1, 2, 3, 4)) if word < 2 else None
        after = lm.likelihood(lm.bigrams(lm.neighbours(read, core, moved), moved))
        assert after >= lm.likelihood(plain) - 1e-6
        if best is not None:
            assert after == pytest.approx(best)
    found, between = lm.clustered(read, core, 8)
    assert lm.likelihood(between) > lm.likelihood(plain)


def test_nothing_learned(spark):
    assert lm.scored(lm.fitted(frame(spark, []))).count() == 0
    out = next(i for i in range(100) if not learned(i))
    rows = lm.scored(lm.fitted(frame(spark, [(out, "some words"), (None, None)]))).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_query(spark, sf_dir):
    got = lm.op12_class_bigrams(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
