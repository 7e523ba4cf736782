"""Class-based bigrams: exchange clustering of words, then class transitions times word emissions.

The probability of a word after another is that of its class after the other's class, times the share of the
word in its class. Texts are read once into blocks of numbered tokens. Every further pass over them is a few
array operations for each block:

1.  Words are counted. The most frequent ones (``CORE``) are exchanged between classes: each round gathers, for
    every core word, the classes of its neighbours over all training texts, and moves words one at a time to the
    class that raises the likelihood of the class bigrams most.
2.  Every other word is put into the class that makes its neighbours likeliest, from all its occurrences.
3.  Transitions are counted over all training texts by these classes, and every text is scored.

Words that training texts hold once stand for unknown ones: how often they follow a class is the probability of
an unknown word there, and what follows them is what follows unknown words. All known words and one unknown word
share a probability of one after every class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import pieces, shuffle_parts, stored, table, text_bytes, utf8

CLASSES = 64
CORE = 4096  # words that rounds of exchange place; all others follow by their neighbours
ROUNDS = 8
BLOCK = 1 << 21  # tokens of a block; a longer text is a block of its own
FOLDS, FOLD = 10, 0
REST, END, UNKNOWN = CLASSES, CLASSES + 1, CLASSES + 2  # classes of words not placed yet, of ends, of unknown words
SIDES = CLASSES + 3
SLICES = 16
PACK = 1 << 18  # words of blocks that a task gathers before it sends them on
UNKNOWN_WEIGHT, CLASS_WEIGHT = 50.0, 5.0
_PIECE = 4 << 20


class _Numbers(dict):
    """Numbers for words in the order in which they first occur."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _zip(values: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == FOLD


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block``, its ``words`` (line by line, the first is the end), ``tokens`` (their numbers, text after text),
    and of each text ``sizes``, ``learn`` (whether it is learned from) and ``ids``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        number, held, learn, ids, size = _Numbers({b"": 0}), [], [], [], 0

        def sent() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            sizes = np.array([len(h) for h in held], np.int32)
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + nth]), pa.array([_zip(b"\n".join(number))], pa.binary()),
                 pa.array([_zip(tokens.tobytes())], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
                 pa.array([np.array(learn, bool).tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)], names=names)

        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                for text, known in zip(text_bytes(part.column(2)), part.column(1).to_pylist(), strict=True):
                    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
                    held.append(np.array([*map(number.__getitem__, words), 0], np.int32))
                    learn.append(known)
                    size += len(words) + 1
                ids.append(part.column(0))
                if size >= BLOCK:
                    yield sent()
                    nth += 1
                    number, held, learn, ids, size = _Numbers({b"": 0}), [], [], [], 0
        if held:
            yield sent()

    names = ["block", "words", "tokens", "sizes", "learn", "ids"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(~held_out(id_col), F.lit(False)).alias("_learn"),
                       utf8(text_col).alias("_text")).mapInArrow(
        scan, f"block long, words binary, tokens binary, sizes binary, learn binary, ids array<{kind}>")


def _tokens(tokens: bytes, sizes: bytes, learn: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a block, the texts' sizes and which of the tokens are learned from."""
    sizes = np.frombuffer(sizes, np.int32)
    return (np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.int32), sizes,
            np.repeat(np.frombuffer(learn, bool), sizes))


_ENTRY = np.dtype([("at", "<i4"), ("n", "<i8"), ("class", "u1")])


def _packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, n, class) gathered into one value for each block."""
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        block = np.concatenate([b.column(0).to_numpy() for b in held])
        rows = np.empty(len(block), _ENTRY)
        for k, name in enumerate(_ENTRY.names, 1):
            rows[name] = np.concatenate([b.column(k).to_numpy() for b in held])
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        begin = np.nonzero(np.diff(block, prepend=-1))[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[begin]), pa.array([rows[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(rows)], strict=True)],
                                              pa.binary())], names=["block", "entries"])

    for batch in found:
        held.append(batch)
        size += batch.num_rows
        if size >= PACK:
            yield sent()
            held, size = [], 0
    if size:
        yield sent()


def _words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def word_counts(read: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all tokens learned from; the end is the empty word."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, _, learn = _tokens(*rest)
                names = _words(words)
                n = np.bincount(tokens[learn], minlength=len(names))
                some = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(some)), pa.array(n[some])],
                    names=["word", "n"])

    return (read.select("words", "tokens", "sizes", "learn").mapInArrow(scan, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def neighbours(read: DataFrame, core: dict[bytes, int], classes: np.ndarray) -> np.ndarray:
    """(side, word, class) counts of the classes before and after each core word, over all texts learned from.

    Two more words stand for the words not placed and for the end; one more class says how often a word follows
    itself. Every task adds up its blocks, and slices of words are added up in a shuffle.
    """
    size, per = len(core) + 2, -(-(len(core) + 2) // SLICES)
    of_core = np.concatenate((classes, [REST, END])).astype(np.int64)
    parts = shuffle_parts(read.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, SIDES), np.int64)
        for batch in batches:
            for words, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, _, learn = _tokens(*rest)
                place = np.array([core.get(w, size - 2) for w in _words(words)], np.int64)
                place[0] = size - 1
                now = place[tokens[learn]]
                before = np.concatenate(([size - 1], now[:-1]))
                for side, (own, other) in enumerate(((now, before), (before, now))):
                    total[side] += np.bincount(own * SIDES + of_core[other], minlength=size * SIDES).reshape(size, SIDES)
                total[0, :, UNKNOWN] += np.bincount(now[now == before], minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SLICES)), pa.array([_zip(total[:, s * per:(s + 1) * per].tobytes()) for s in range(SLICES)],
                                                   pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
                total[s] = total[s] + counts if s in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["slice", "counts"])

    rows = (read.select("words", "tokens", "sizes", "learn").mapInArrow(scan, "slice long, counts binary")
            .repartition(min(parts, SLICES), "slice").mapInArrow(add, "slice long, counts binary").collect())
    out = np.zeros((2, SLICES * per, SIDES), np.int64)
    for r in rows:
        part = np.frombuffer(r["counts"], np.int64).reshape(2, -1, SIDES)
        out[:, r["slice"] * per:r["slice"] * per + part.shape[1]] = part
    return out[:, :size]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def bigrams(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(class before, class) counts from the neighbours of all words."""
    out = np.zeros((SIDES - 1, SIDES - 1))
    np.add.at(out, np.concatenate((classes, [REST, END])), counts[1][:, :-1])
    return out


def likelihood(between: np.ndarray) -> float:
    """What the classes decide of the log likelihood of the class bigrams."""
    return float(_xlogx(between).sum() - _xlogx(between.sum(axis=0)).sum() - _xlogx(between.sum(axis=1)).sum())


def exchanged(counts: np.ndarray, classes: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """The classes after each movable word has gone, in turn, where the likelihood gains most.

    The bigrams of the classes follow each move; a word's neighbours are those of the round's beginning.
    """
    classes = classes.copy()
    between = bigrams(counts, classes)
    own = np.arange(CLASSES)
    for i in movable:
        a, own_pairs = classes[i], float(counts[0, i, UNKNOWN])
        before, after = (counts[s, i, :-1].astype(float) for s in (0, 1))
        between[a] -= after
        between[:, a] -= before
        between[a, a] += own_pairs
        before[a] -= own_pairs
        after[a] -= own_pairs
        np.maximum(between, 0, out=between)  # moves of this round may leave a stale neighbour in a class
        rows, columns = between[:CLASSES], between[:, :CLASSES].T
        gain_rows = _xlogx(rows + after) - _xlogx(rows)
        gain_columns = _xlogx(columns + before) - _xlogx(columns)
        same = between[own, own]
        gain = (gain_rows.sum(axis=1) - gain_rows[own, own] + gain_columns.sum(axis=1) - gain_columns[own, own]
                + _xlogx(same + before[:CLASSES] + after[:CLASSES] + own_pairs) - _xlogx(same))
        for side, marginal in ((after, rows), (before, columns)):
            total = marginal.sum(axis=1)
            gain -= _xlogx(total + side.sum() + own_pairs) - _xlogx(total)
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-6:
            b = a
        between[b] += after
        between[:, b] += before
        between[b, b] += own_pairs
        classes[i] = b
    return classes


def clustered(read: DataFrame, core: dict[bytes, int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core words, and the bigrams of the classes. Half of the words may move in a round."""
    classes = np.arange(len(core)) % CLASSES
    for k in range(rounds):
        moved = exchanged(neighbours(read, core, classes), classes, np.arange(k % 2, len(core), 2))
        if k and (moved == classes).all():
            break
        classes = moved
    return classes, bigrams(neighbours(read, core, classes), classes)


def placements(between: np.ndarray) -> np.ndarray:
    """(class before and class after, class) log probabilities of a word of the class between such neighbours."""
    size = SIDES - 1
    share = np.log((between + 0.5) / (between.sum(axis=1, keepdims=True) + 0.5 * size))
    into, out = share[:, :CLASSES], share[:CLASSES].T
    return (into[:, None, :] + out[None, :, :]).reshape(size * size, CLASSES).astype(np.float32)


def placed(read: DataFrame, core: dict[bytes, int], core_n: np.ndarray, classes: np.ndarray,
           between: np.ndarray, named: bool = False) -> DataFrame:
    """``at`` (a word's number in its block), ``n`` (0 if unknown) and ``class`` of every block's words: as packed
    ``entries`` of a ``block``, or if ``named`` as rows with the ``block`` and the ``word``.

    Words outside the core go to the class in which their occurrences are likeliest. A word comes to its task row
    by row, one for each block that holds it, with the classes of its neighbours; the task keeps the blocks only.
    """
    size, parts = SIDES - 1, shuffle_parts(read.sparkSession)
    of_core = np.concatenate((classes, [REST, END])).astype(np.int64)
    numbers = np.concatenate((core_n, [0, 0]))
    odds = placements(between)
    crowd = np.log(between.sum(axis=1)[:CLASSES] + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, _, learn = _tokens(*rest)
                names = _words(words)
                place = np.array([core.get(w, len(core)) for w in names], np.int64)
                place[0] = len(core) + 1
                now = tokens[learn]
                kind = of_core[place[now]]
                pair = np.concatenate(([END], kind[:-1])) * size + np.concatenate((kind[1:], [END]))
                rest_ = np.nonzero(kind == REST)[0]
                order = np.lexsort((pair[rest_], now[rest_]))
                cells = pair[rest_][order].astype("<u2")
                ends = 2 * np.cumsum(np.bincount(now[rest_], minlength=len(names)))
                columns = [
                    pa.array(np.full(len(names), block)), pa.array(np.arange(len(names), dtype=np.int32)),
                    pa.array(names, pa.binary()).cast(pa.string()), pa.array(numbers[place]),
                    pa.array(np.where(place < len(core), of_core[place], -1).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(names), [
                        None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()),
                        pa.py_buffer(cells.tobytes())])]
                made = pa.RecordBatch.from_arrays(columns, names=["block", "at", "word", "n", "class", "cells"]).slice(1)
                for start in range(0, made.num_rows, 1 << 14):
                    yield made.slice(start, 1 << 14)

    def told(block, at, word, n, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(kind, pa.int32()),
             *[word] * named], names=names)

    def best(score: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, (score - n[:, None] * crowd).argmax(axis=1), UNKNOWN)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, score, n, held = None, None, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            if last is not None:
                kind = best(score[None], np.array([n]))[0]
                for block, at in held:
                    yield told(block, at, pa.array([last], pa.string()).take(pa.array(np.zeros(len(block), np.int64))),
                               np.full(len(block), n), np.full(len(block), kind))

        for batch in batches:
            fixed = pc.greater_equal(batch.column(4), 0)
            ready = batch.filter(fixed)
            if ready.num_rows:
                yield ready.select(names)
            batch = batch.filter(pc.invert(fixed))
            if not batch.num_rows:
                continue
            block, at, word = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            changed = np.concatenate(([True], pc.not_equal(word.slice(1), word.slice(0, len(word) - 1))
                                      .to_numpy(zero_copy_only=False).astype(bool)))
            begin = np.nonzero(changed)[0]
            lengths = pc.binary_length(batch.column(5)).to_numpy().astype(np.int64) // 2
            cells = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u2")
            counts = np.add.reduceat(lengths, begin)
            scores, group = np.zeros((len(begin), CLASSES)), np.repeat(np.arange(len(begin)), counts)
            for x in range(0, len(cells), 1 << 15):
                some = group[x:x + (1 << 15)]
                first = np.nonzero(np.diff(some, prepend=-1))[0]
                scores[some[first]] += np.add.reduceat(odds[cells[x:x + (1 << 15)]].astype(float), first)
            stops = np.append(begin[1:], len(word))
            if word[0].as_py() == last:
                scores[0] += score
                counts[0] += n
                if len(begin) > 1:
                    score, n = scores[0], counts[0]
                    yield from closed()
                    held = []
            else:
                yield from closed()
                held = []
            group = np.repeat(np.arange(len(begin)), stops - begin)
            if len(begin) > 1:
                kinds = best(scores[:-1], counts[:-1])
                some = group[:begin[-1]]
                yield told(block[:begin[-1]], at[:begin[-1]], word.slice(0, begin[-1]), counts[some], kinds[some])
            last, score, n = word[len(word) - 1].as_py(), scores[-1], counts[-1]
            held.append((block[begin[-1]:].copy(), at[begin[-1]:].copy()))
        yield from closed()

    def fold_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(fold(batches))

    names = ["block", "at", "n", "class", *["word"] * named]
    rows = (read.select("block", "words", "tokens", "sizes", "learn")
            .mapInArrow(scan, "block long, at int, word string, n long, class int, cells binary")
            .repartition(parts, "word").sortWithinPartitions("word"))
    if named:
        return rows.mapInArrow(fold, "block long, at int, n long, class int, word string")
    return rows.mapInArrow(fold_packed, "block long, entries binary")


def coded(read: DataFrame, found: DataFrame, total: int, distinct: int) -> DataFrame:
    """Of each block the texts' ``ids``, numbers of tokens and known tokens, ``base`` score and ``emission`` (the
    logarithms of the words' counts), the ``classes`` of all tokens, and the ``transitions`` of those learned from.

    ``found`` are the packed words of ``placed``. A block meets its words in one shuffle; a task holds one block at a
    time.
    """
    parts = shuffle_parts(read.sparkSession)
    kind = read.schema["ids"].dataType.simpleString()
    columns = ["block", "rest", "data", "sizes", "learn", "ids"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "binary"), ("learn", "binary"), ("ids", kind))]
    both = read.select("block", F.lit(0).alias("rest"), F.col("tokens").alias("data"), "sizes", "learn", "ids").unionByName(
        found.select("block", F.lit(1).alias("rest"), F.col("entries").alias("data"), *none))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, entries = None, []
        for batch in batches:
            for row, rest in enumerate(batch.column(1).to_pylist()):
                if rest:
                    entries.append(np.frombuffer(batch.column(2)[row].as_py(), _ENTRY))
                    continue
                if texts is not None:
                    yield made(texts, entries)
                texts, entries = batch.slice(row, 1), []
        if texts is not None:
            yield made(texts, entries)

    def made(texts: pa.RecordBatch, entries: list[np.ndarray]) -> pa.RecordBatch:
        tokens, sizes, learn = _tokens(*(texts.column(c)[0].as_py() for c in (2, 3, 4)))
        words = np.concatenate([np.zeros(0, _ENTRY), *entries])
        at = words["at"]
        count, kind_of = np.zeros(len(at) + 1, np.int64), np.full(len(at) + 1, UNKNOWN, np.int64)
        count[at], kind_of[at] = words["n"], words["class"]
        count[0], kind_of[0] = ends, END
        if not ends:
            kind_of[0] = UNKNOWN
        begin = np.cumsum(sizes) - sizes
        log_count = np.log10(np.maximum(count, 1))
        base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        sums = [np.add.reduceat(v[tokens], begin) for v in ((count > 0).astype(np.int64), base, log_count)]
        now, once = kind_of[tokens], (count == 1)[tokens]
        old = np.concatenate(([kind_of[0]], now[:-1])), np.concatenate(([False], once[:-1]))
        counts = np.bincount(old[0][learn] * SIDES + now[learn], minlength=SIDES * SIDES).reshape(SIDES, SIDES)
        first = np.arange(len(tokens)) == np.repeat(begin, sizes)
        after_once = old[1] & ~first
        counts[:, UNKNOWN] += np.bincount(old[0][learn & once], minlength=SIDES)
        counts[UNKNOWN] += np.bincount(now[learn & after_once], minlength=SIDES)
        counts[UNKNOWN, UNKNOWN] += (learn & after_once & once).sum()
        texts_ids = texts.column(5)
        return pa.RecordBatch.from_arrays(
            [texts_ids, pa.array([sizes.tolist()], pa.list_(pa.int32())), *(
                pa.array([s.tolist()], pa.list_(t)) for s, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()), strict=True)),
             pa.array([_zip(now.astype(np.uint8).tobytes())], pa.binary()), pa.array([_zip(counts.tobytes())], pa.binary())],
            names=["ids", "sizes", "known", "base", "emission", "classes", "transitions"])

    ends = _ends(read)
    return (both.select(columns).repartition(parts, "block").sortWithinPartitions("block", "rest").mapInArrow(
        scan, f"ids {kind}, sizes array<int>, known array<long>, base array<double>, emission array<double>, "
              "classes binary, transitions binary"))


def _ends(read: DataFrame) -> int:
    """Texts learned from."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(x, bool).sum() for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return read.select("learn").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def transitions(texts: DataFrame) -> np.ndarray:
    """(class before, class) counts over all blocks; the rows of a task are added up before the shuffle."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDES * SIDES, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(SIDES * SIDES, np.int64)
    for r in (texts.select("transitions").mapInArrow(scan, "cell long, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).collect()):
        out[r["cell"]] = r["n"]
    return out.reshape(SIDES, SIDES)


@dataclass
class Transitions:
    """Log10 probabilities: ``step[before, class]`` of a class after another (of an unknown word in the last column),
    divided by the number of tokens in the class."""
    step: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Transitions:
        known = counts[:, :UNKNOWN].astype(float)
        in_class = known[:UNKNOWN].sum(axis=0)
        total = in_class.sum()
        if not total:  # nothing learned: every word is unknown
            step = np.full((SIDES, SIDES), -np.inf)
            step[:, UNKNOWN] = 0
            return cls(step)
        seen = known.sum(axis=1, keepdims=True)
        once = counts[:UNKNOWN, UNKNOWN].sum()
        unknown = ((counts[:, UNKNOWN:] + UNKNOWN_WEIGHT * (once + 0.5) / (total + 1)) / (seen + UNKNOWN_WEIGHT))
        after = (known + CLASS_WEIGHT * in_class / total) / (seen + CLASS_WEIGHT)
        with np.errstate(divide="ignore"):
            return cls(np.concatenate((np.log10((1 - unknown) * after) - np.log10(np.maximum(in_class, 1)),
                                       np.log10(unknown)), axis=1))


@dataclass
class Fitted:
    words: DataFrame  # each block's words with their counts and classes
    texts: DataFrame
    transitions: Transitions
    tokens: int


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """The model of the texts outside the held-out fold, with all texts as classes.

    A null text is empty, and an empty text one token, its end. A text with a null id is not learned from.
    """
    read = stored(blocks(docs, id_col, text_col))
    counts = stored(word_counts(read))
    distinct, total = counts.agg(F.count("*"), F.sum("n")).first()
    top = counts.where("word != ''").orderBy(F.desc("n"), "word").limit(CORE).collect()
    core = {r["word"].encode(): k for k, r in enumerate(top)}
    classes, between = clustered(read, core)
    core_n = np.array([r["n"] for r in top], np.int64)
    texts = stored(coded(read, placed(read, core, core_n, classes, between), total or 0, distinct))
    return Fitted(placed(read, core, core_n, classes, between, named=True), texts,
                  Transitions.of(transitions(texts)), total or 0)


def scored(model: Fitted, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every text, from its classes."""
    step = model.transitions.step

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, known, base, emission = (batch.column(c)[row].values for c in (1, 2, 3, 4))
                now = np.frombuffer(large.decompress(batch.column(5)[row].as_py()), np.uint8).astype(np.int64)
                begin = np.cumsum(sizes.to_numpy()) - sizes.to_numpy()
                old = np.concatenate((now[-1:], now[:-1]))  # a text begins after an end, and each ends with one
                value = np.add.reduceat(step[old, now], begin) + emission.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, sizes.cast(pa.int64()), known, base, pa.array(value)],
                    names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    kind = model.texts.schema["ids"].dataType.elementType.simpleString()
    return model.texts.select("ids", "sizes", "known", "base", "emission", "classes").mapInArrow(
        scan, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def op12_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted(table(spark, sf_dir, "documents"))
    return scored(model).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
