"""Toxicity by weak supervision.

Lexicon voters (words and word beginnings) are mined from labelled training rows, pattern voters read how
many and how dense the lexicon's words are. A generative model of the latent class estimates each voter's
accuracy by expectation-maximisation, discounts voters for what they share beyond the class, and gives every
training row a posterior. A linear classifier on word counts learns the posteriors and scores any text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import cut, pieces, table, utf8

TRAIN_ROWS = 20_000  # labelled rows that are learned from, the least by hash
LEXICON = 256
STEMS = range(3, 9)  # lengths of word beginnings
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
_PIECE = 4 << 20
_LEVELS = (1, 2, 3, 5)
_DENSITIES = (0.002, 0.005, 0.01, 0.02)


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def training_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int,
                    rows: int = TRAIN_ROWS) -> DataFrame:
    """``_id``, ``_label`` of at most ``rows`` rows outside the held-out fold; ids whose labels disagree are left out."""
    clear = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_other"))
             .where("_label = _other"))
    mine = clear.where(~held_out("_id", folds, fold)).select("_id", F.col("_label").cast("int").alias("_label"))
    return mine.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int,
                  fold: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """``_id``, ``_text`` and ``_label`` of the training rows; ``rows`` bounds what is broadcast."""
    mine = training_labels(labels, id_col, label_col, folds, fold, rows)
    texts = docs.select(F.col(id_col).alias("_doc"), utf8(text_col).alias("_text"))
    return cut(texts.join(F.broadcast(mine), F.col("_doc") == F.col("_id")).select("_id", "_text", "_label"))


def _counted(text: str) -> tuple[Counter, int]:
    words = WORD.findall(text.lower())
    return Counter(words), len(words)


def mine_lexicon(rows: DataFrame, size: int = LEXICON) -> list[tuple[str, bool, float]]:
    """(entry, whether it is a beginning, log odds) of the words and beginnings that mark label 1.

    A beginning has to occur in two different words of a text. Counts are combined per task and in a shuffle;
    the few best entries come to the driver, and one that an accepted entry covers is passed over.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, _ = _counted(text)
                stems = Counter(w[:n] + "*" for w in words for n in STEMS if len(w) > n)
                for entry in [*words, *(s for s, n in stems.items() if n > 1)]:
                    seen.setdefault(entry, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
             pa.array([v[1] for v in seen.values()], pa.int64())], names=["entry", "clean", "toxic"])

    totals = rows.agg(F.sum(1 - F.col("_label")), F.sum("_label")).first()
    clean, toxic = (int(x or 0) for x in totals)
    if not clean or not toxic:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - float(np.log((toxic + 1) / (clean + 1)))
    found = (rows.select("_text", "_label").mapInArrow(count, "entry string, clean long, toxic long")
             .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .withColumn("odds", odds - 1.3 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
             .where((F.col("toxic") >= max(4, toxic // 200)) & (F.col("odds") > 1.5))
             .withColumn("gain", F.col("odds") * F.sqrt("toxic"))
             .orderBy(F.desc("gain"), "entry").limit(8 * size).collect())
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    for r in found:
        entry, stem = r.entry.removesuffix("*"), r.entry.endswith("*")
        if any(entry[:n] in stems for n in range(STEMS[0], len(entry) + 1)):
            continue
        if stem:
            stems.add(entry)
        chosen.append((entry, stem, float(r.odds)))
        if len(chosen) == size:
            break
    return chosen


class Features:
    """Counts of the lexicon's entries in a text, its words, and the patterns read off them."""

    def __init__(self, lexicon: list[tuple[str, bool, float]]):
        self.words = {e: i for i, (e, stem, _) in enumerate(lexicon) if not stem}
        self.stems = {e: i for i, (e, stem, _) in enumerate(lexicon) if stem}
        self.lengths = sorted({len(e) for e in self.stems})
        self.odds = np.array([o for _, _, o in lexicon])
        self.size = len(lexicon)

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        words, total = _counted(text)
        found: dict[int, int] = {}
        for word, n in words.items():
            i = self.words.get(word)
            if i is not None:
                found[i] = found.get(i, 0) + n
            for size in self.lengths:
                i = self.stems.get(word[:size])
                if i is not None and len(word) > size:
                    found[i] = found.get(i, 0) + n
        return found, total

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts (row, entry) and words per row."""
        counts, totals = np.zeros((len(texts), self.size), np.float32), np.zeros(len(texts))
        for r, text in enumerate(texts):
            found, totals[r] = self.counts(text)
            for i, n in found.items():
                counts[r, i] = n
        return counts, totals


def _patterns(counts: np.ndarray, totals: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits and hits for each word, weighted by how strongly an entry marks the class."""
    weight = np.clip(odds / 4.0, 0.25, 1.0)
    hits = counts @ weight if len(odds) else np.zeros(len(totals))
    return hits, hits / np.maximum(totals, 50)


def votes(counts: np.ndarray, totals: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One column for each voter, 1 where it votes: the entries, then levels of hits and of their density."""
    hits, density = _patterns(counts, totals, odds)
    levels = [hits >= n for n in _LEVELS] + [density >= d for d in _DENSITIES] + [hits == 0]
    return np.concatenate((counts > 0, np.stack(levels, axis=1)), axis=1).astype(np.float32)


def _rates(ballots: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter votes in class 1 and in class 0."""
    return ((posterior @ ballots + 0.5) / (posterior.sum() + 1),
            ((1 - posterior) @ ballots + 0.5) / ((1 - posterior).sum() + 1))


def _shares(ballots: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """One over the voters that say the same as a voter beyond what the class explains."""
    rate1, rate0 = _rates(ballots, posterior)
    rest = ballots - posterior[:, None] * rate1 - (1 - posterior)[:, None] * rate0
    spread = np.sqrt((rest**2).mean(axis=0) + 1e-9)
    related = np.abs((rest.T @ rest) / len(rest) / np.outer(spread, spread))
    return 1 / np.where(related > 0.1, related, 0).sum(axis=1).clip(1)


def label_model(ballots: np.ndarray, labels: np.ndarray, noise: float = 0.02, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 for each row.

    The given label is one more voter that errs with probability ``noise``. Each voter's rates of voting in
    either class come from expectation-maximisation; a voter's say is divided by the correlations within the
    classes it has with the other voters, which are estimated again whenever the posteriors have settled.
    """
    posterior = np.where(labels == 1, 1 - noise, noise).astype(np.float64)
    given = np.where(labels == 1, 1.0, -1.0) * np.log((1 - noise) / noise)
    for _ in range(4):
        share = _shares(ballots, posterior)
        for _ in range(rounds):
            prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            rate1, rate0 = _rates(ballots, posterior)
            yes, no = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
            told = ballots @ (share * (yes - no)) + (share * no).sum() + np.log(prior / (1 - prior)) + given
            new = 1 / (1 + np.exp(-np.clip(told, -30, 30)))
            done = np.abs(new - posterior).max() < 1e-4
            posterior = new
            if done:
                break
    return posterior


def inputs(counts: np.ndarray, totals: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """What the linear classifier sees of a text."""
    hits, density = _patterns(counts, totals, odds)
    more = [np.minimum(hits, 6), *(hits >= n for n in _LEVELS), np.minimum(density * 100, 6),
            *(density >= d for d in _DENSITIES), np.log1p(hits) - 0.3 * np.log1p(totals / 100), np.ones(len(totals))]
    return np.concatenate((np.minimum(counts, 2), np.stack(more, axis=1)), axis=1).astype(np.float64)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 2.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + ridge * weights
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class Model:
    lexicon: list[tuple[str, bool, float]]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        features = Features(self.lexicon)
        counts, totals = features.matrix(texts)
        return 1 / (1 + np.exp(-np.clip(inputs(counts, totals, features.odds) @ self.weights, -30, 30)))


def train(rows: DataFrame, size: int = LEXICON) -> Model:
    """The model of ``training_rows``; with no row of either class, one that scores the share of label 1."""
    lexicon = mine_lexicon(rows, size)
    features = Features(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, totals = features.matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals.astype(np.int64)), batch.column(2),
                 pa.array([c.astype("<f4").tobytes() for c in counts], pa.binary())],
                names=["_id", "words", "label", "counts"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_text", "_label").mapInArrow(
        count, f"_id {kind}, words long, label int, counts binary").orderBy("_id", "counts").toPandas()
    if not len(found):
        return Model([], inputs(np.zeros((1, 0)), np.zeros(1), np.zeros(0))[0] * 0)
    counts = np.frombuffer(b"".join(found["counts"]), "<f4").reshape(len(found), features.size)
    totals, labels = found["words"].to_numpy(float), found["label"].to_numpy()
    ballots = votes(counts, totals, features.odds)
    posterior = label_model(ballots, labels)
    return Model(lexicon, fit_linear(inputs(counts, totals, features.odds), posterior))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row's whole text; null texts score as empty ones."""
    features = Features(model.lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                counts, totals = features.matrix(part.column(1).to_pylist())
                x = inputs(counts, totals, features.odds) @ model.weights
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(scan, f"`{id_col}` {kind}, score double")


FOLDS, FOLD = 3, 1


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    return train(training_rows(docs, labels, id_col, "text", "toxic", FOLDS, FOLD))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with all their columns."""
    features = Features(model.lexicon)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, _PIECE):
                counts, totals = features.matrix([t or "" for t in part.column(at).to_pylist()])
                x = inputs(counts, totals, features.odds) @ model.weights
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
