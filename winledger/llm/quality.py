"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from what its characters and words look like;
gated attention, learned from document labels alone, weighs the passages, and the weighted representation
is scored. Training runs on a bounded number of labelled documents; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm import windows
from winledger.llm.shared import pieces, table, text_bytes, utf8
from winledger.llm.toxicity import held_out, training_rows

PASSAGE = 64  # words
TRAIN_ROWS = 20_000  # labelled documents that are learned from, the least by hash
THRESHOLD = 0.3
FOLDS, FOLD = 5, 0
HIDDEN, GATE = 24, 16
_PIECE = 1 << 20

# Kinds of bytes that are counted.
_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#$%&*@^~=+_<>\\/",
                             b":;'\"()[]{}-", b"\n"), start=1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 10
_N_KINDS = 11


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What each passage looks like (one row), and how many passages each text has (one at least)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # A blank between texts keeps their words apart.
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ink = np.concatenate(([False], ~windows._BLANK[whole], [False]))
    edge = np.nonzero(ink[1:] != ink[:-1])[0]
    first, stop = edge[::2], edge[1::2]
    doc = np.searchsorted(begin, first, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    counts = np.maximum(1, -(-words // PASSAGE))
    n = int(counts.sum())
    offset = np.concatenate(([0], np.cumsum(counts)[:-1]))
    nth = np.arange(len(first)) - np.repeat(np.concatenate(([0], np.cumsum(words)[:-1])), words)
    place = offset[doc] + nth // PASSAGE
    in_passage = np.bincount(place, minlength=n).astype(float)
    some = np.maximum(in_passage, 1)

    def share(values: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=values, minlength=n) / some

    length = stop - first
    running = np.zeros((_N_KINDS, len(whole) + 1), np.int32)
    kinds = _KINDS[whole]
    for k in range(1, _N_KINDS):
        np.cumsum(kinds == k, out=running[k, 1:])
    inside = [running[k, stop] - running[k, first] for k in range(1, _N_KINDS)]
    breaks = running[9, first] - running[9, np.maximum(first - 1, 0)]
    letters = windows.Hashes(windows._BYTE[whole], windows.BASES[1]).of(first, stop)
    order = np.lexsort((letters, place))
    new = np.concatenate(([True], (letters[order][1:] != letters[order][:-1]) | (place[order][1:] != place[order][:-1])))
    distinct = np.bincount(place[order], weights=new, minlength=n) / some
    top = np.zeros(n)
    if len(order):
        starts = np.nonzero(new)[0]
        np.maximum.at(top, place[order][starts], np.diff(np.append(starts, len(order))))
    again = np.zeros(len(first))
    if len(first) > 1:
        again[1:] = (letters[1:] == letters[:-1]) & (place[1:] == place[:-1])
    upper, ends = inside[0], _KINDS[whole[stop - 1]] if len(stop) else np.zeros(0, np.int64)
    rows = [in_passage / PASSAGE, np.repeat(np.log1p(words), counts) / 5, share(length) / 8,
            share((length <= 2).astype(float)), share((length >= 12).astype(float)), share(upper / np.maximum(length, 1)),
            share(((upper == 1) & (_KINDS[whole[first]] == 1)).astype(float)) if len(first) else np.zeros(n),
            distinct, top / some, share(again), share(breaks.astype(float))]
    rows += [share(inside[k].astype(float)) for k in (1, 2, 3, 4, 5, 6, 7, 9)]
    rows += [share((ends == k).astype(float)) for k in (3, 4, 5, 6, 7)]
    return np.stack(rows, axis=1).astype(np.float32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, s = np.tanh(h @ w["attend"]), _sigmoid(h @ w["gate"])
        e = (t * s) @ w["weigh"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "begin": begin,
                "score": _sigmoid(z @ w["out"] + w["out0"])}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["score"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some bags."""
        w, f = self.weights, self.forward(x, counts)
        bag, a, h = f["bag"], f["a"], f["h"]
        d = (f["score"] - labels) / len(labels)
        dz = d[:, None] * w["out"][None, :]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["begin"])[bag])
        dts = de[:, None] * w["weigh"][None, :]
        dt, ds = dts * f["s"] * (1 - f["t"]**2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = a[:, None] * dz[bag] + dt @ w["attend"].T + ds @ w["gate"].T
        dp = dh * (1 - h**2)
        return {"encode": f["x"].T @ dp, "encode0": dp.sum(axis=0), "attend": h.T @ dt, "gate": h.T @ ds,
                "weigh": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "out0": np.array([d.sum()])}


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 5e-3,
        decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam over shuffled batches of bags."""
    rng = np.random.default_rng(seed)
    n = x.shape[1] if x.ndim == 2 else 1
    make = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(n), (x.std(axis=0) if len(x) else np.zeros(n)) + 0.02, {
        "encode": make(n, HIDDEN), "encode0": np.zeros(HIDDEN), "attend": make(HIDDEN, GATE), "gate": make(HIDDEN, GATE),
        "weigh": make(GATE), "out": make(HIDDEN), "out0": np.array([np.log(share / (1 - share))])})
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    begin = np.concatenate(([0], np.cumsum(counts)))
    step = 0
    total = max(1, epochs * -(-len(labels) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            some = np.sort(order[at:at + batch])
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
            step += 1
            for k, g in model.gradients(x[rows], counts[some], labels[some]).items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - rate * (1 - step / (total + 1)) * (
                    first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(rows: DataFrame) -> Model:
    """The model of ``training_rows``; their passages, not their texts, come to the driver."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                x, counts = passages(text_bytes(part.column(1)))
                at = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts),
                     pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["_id", "label", "passages", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_text", "_label").mapInArrow(
        look, f"_id {kind}, label int, passages long, x binary").toPandas().sort_values(["_id", "x"])
    width = passages([b""])[0].shape[1]
    x = np.frombuffer(b"".join(found["x"]), "<f4").reshape(-1, width).astype(np.float64)
    return fit(x, found["passages"].to_numpy(), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: label 1 likelier) of every row; a null text scores as an empty one."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                x, counts = passages(text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(x, counts))],
                                                 names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(scan, f"`{id_col}` {kind}, score double")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    return train(training_rows(docs, labels, id_col, "text", "quality", FOLDS, FOLD, TRAIN_ROWS))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
