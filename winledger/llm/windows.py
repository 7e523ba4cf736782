"""Equal windows of letter sequences: sampling that two equal windows always share.

A document is a sequence of letters (bytes, or hashes of words). Of the short strings inside a window of
``length`` letters, the one with the least hash is its anchor; equal windows have equal anchors at equal
places. Neighbouring windows mostly share their anchor, so one tuple stands for a stretch of windows:

    name     hash of the anchor string
    context  hash of all letters the stretch's windows cover
    start    of the first window; ``count`` windows; ``lead``, how far before the anchor the last one starts

Tuples travel as sorted, delta-coded runs, one per task and bucket of names, and are merged by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winledger.llm.shared import pieces, released, runs, shuffle_parts

U = np.uint64
_MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE = 1 << 18  # letters hashed at a time; longer documents are cut into overlapping slices
FLUSH = 1 << 18  # tuples a task gathers into one run per bucket
OPEN, SHARED, COPIED = 0, 1, 2
CROWD = 64  # contexts of one name in one run; the others go on without being compared here
BUCKET_BYTES = 1 << 20  # of text for each bucket of names

_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    room = 1 << max(10, size.bit_length())
    if (base, room) not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p, step = np.ones(1, U), b
            while len(p) < room:
                p = np.concatenate((p, p * U(step)))
                step = step * step & _MASK
            both.append(p)
        _powers[base, room] = tuple(both)
    return _powers[base, room]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Hashes:
    """Polynomial hashes of any stretches of a letter sequence, from running sums."""

    def __init__(self, letters: np.ndarray, base: int):
        power, self.inverse = _power_tables(base, len(letters) + 1)
        self.sums = np.zeros(len(letters) + 1, U)
        np.cumsum(letters * power[:len(letters)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def byte_letters(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_letters(text: bytes) -> np.ndarray:
    """A 64-bit hash for each run of bytes that are not ASCII blanks."""
    b = np.frombuffer(text, np.uint8)
    ink = np.concatenate(([False], ~_BLANK[b], [False]))
    edge = np.nonzero(ink[1:] != ink[:-1])[0]
    sums = Hashes(_BYTE[b], BASES[1])
    return sums.of(edge[::2], edge[1::2]) * U(2) + U(1)


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


@dataclass
class Tuples:
    name: np.ndarray
    context: np.ndarray
    doc: np.ndarray  # place in the batch
    start: np.ndarray
    count: np.ndarray
    lead: np.ndarray


_PLACE = (1 << 20) - 1


def anchored(docs: list[np.ndarray], length: int, anchor: int) -> Tuples | None:
    """The tuples of some letter sequences of ``SLICE`` letters at most together, laid end to end."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not (sizes >= length).any():
        return None
    letters = np.concatenate(docs)
    ends = np.cumsum(sizes)
    n = len(letters) - length + 1
    doc = np.repeat(np.arange(len(docs)), sizes)[:n]
    valid = np.arange(length, length + n) <= ends[doc]
    names = Hashes(letters, BASES[0]).every(anchor)
    # The first of the least hashes: the place stands in the low bits.
    ranked = (names & U(_MASK ^ _PLACE)) | np.arange(len(names), dtype=U)
    place = (least_in_window(ranked, length - anchor + 1)[:n] & U(_PLACE)).astype(np.int64)
    same = valid[1:] & valid[:-1] & (place[1:] == place[:-1]) & (doc[1:] == doc[:-1])
    begins = np.nonzero(valid & ~np.concatenate(([False], same)))[0]
    stops = np.nonzero(valid & ~np.concatenate((same, [False])))[0]
    whole = Hashes(letters, BASES[1])
    return Tuples(names[place[begins]], whole.of(begins, stops + length), doc[begins],
                  begins - (ends - sizes)[doc[begins]], stops - begins + 1, place[begins] - stops)


def slices(letters: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long sequence in parts that hold every window once, with their first letters' places."""
    step = SLICE - length + 1
    for at in range(0, max(1, len(letters) - length + 1), step):
        yield at, letters[at:at + SLICE]


class Gathered:
    """Tuples of a task's documents, sent on as one sorted run per bucket."""

    def __init__(self, length: int, anchor: int, buckets: int, within: bool):
        self.length, self.anchor, self.buckets, self.within = length, anchor, buckets, within
        self.rows, self.held = [], 0
        self.wait, self.letters = [], 0

    def add(self, doc: int, print_: int, letters: np.ndarray) -> None:
        for at, part in slices(letters, self.length):
            if self.letters + len(part) > SLICE:
                self.hash()
            if len(part) >= self.length:
                self.wait.append((doc, print_, at, part))
                self.letters += len(part)

    def hash(self) -> None:
        if self.wait:
            docs, prints, offsets, parts = zip(*self.wait, strict=True)
            t = anchored(list(parts), self.length, self.anchor)
            self.rows.append((t.name, t.context, np.array(docs, np.int64)[t.doc],
                              np.array(prints, np.int64)[t.doc],
                              (t.start + np.array(offsets)[t.doc]).astype(np.int64),
                              (t.count * 64 + t.lead).astype(np.int16)))
            self.held += len(t.name)
        self.wait, self.letters = [], 0

    def full(self) -> bool:
        return self.held >= FLUSH

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, state, tuples) of what was gathered; only tuples in state OPEN are compared further."""
        self.hash()
        if not self.rows:
            return
        rows = tuple(np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.held = [], 0
        rows, first = in_order(rows)
        name = rows[0]
        begin = np.nonzero(np.concatenate(([True], name[1:] != name[:-1])))[0]
        contexts = np.cumsum(first)
        nth = contexts - np.repeat(contexts[begin], np.diff(np.append(begin, len(name))))
        state = np.where(nth >= CROWD, SHARED, OPEN)  # enough contexts stay to tell the bucket of the crowd
        state[repeated(rows, first, self.within)] = COPIED
        bucket = ((name >> U(32)) * U(self.buckets) >> U(32)).astype(np.int64)
        some = np.nonzero(state == OPEN)[0]
        edges = np.nonzero(np.diff(bucket[some], prepend=-1))[0]
        for x, y in zip(edges, np.append(edges[1:], len(some)), strict=True):
            part = some[x:y]
            yield int(bucket[part[0]]), OPEN, packed(tuple(c[part] for c in rows))
        head = np.nonzero(first)[0][contexts - 1]
        from_ = (rows[2][head], rows[4][head])
        for kind in (SHARED, COPIED):
            some = np.nonzero(state == kind)[0]
            for x in range(0, len(some), 1 << 14):
                part = some[x:x + (1 << 14)]
                yield int(name[part[0]] % U(self.buckets)), kind, packed(tuple(c[part] for c in (*rows, *from_)))


def repeated(rows: tuple[np.ndarray, ...], first: np.ndarray, within: bool) -> np.ndarray:
    """Which sorted tuples have an equal one in a smaller document or, if ``within``, earlier in their own."""
    _, _, doc, print_, start, _ = rows
    head = np.nonzero(first)[0][np.cumsum(first) - 1]
    copied = doc > doc[head]
    if within:
        own = first.copy()
        own[1:] |= (doc[1:] != doc[:-1]) | (print_[1:] != print_[:-1])
        copied |= start > start[np.nonzero(own)[0][np.cumsum(own) - 1]]
    return copied


def in_order(rows: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The tuples sorted by name, context, document and place; which of them begin a context."""
    name, context, doc, print_, start, _ = rows
    order = np.lexsort((start, print_, doc, context, name))
    rows = tuple(c[order] for c in rows)
    name, context = rows[:2]
    return rows, np.concatenate(([True], (name[1:] != name[:-1]) | (context[1:] != context[:-1])))


_KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int16, np.int64, np.int64)


def packed(rows: tuple[np.ndarray, ...]) -> bytes:
    """Columns as byte planes, so that the constant high bytes compress; names as differences."""
    name = np.diff(rows[0], prepend=U(0))
    columns = (name, *rows[1:])
    return len(name).to_bytes(8, "little") + b"".join(
        np.ascontiguousarray(c.astype(k).view(np.uint8).reshape(len(name), -1).T).tobytes()
        for c, k in zip(columns, _KINDS, strict=False))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    n, at, columns = int.from_bytes(data[:8], "little"), 8, []
    for k in _KINDS:
        if at == len(data):
            break
        size = np.dtype(k).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        columns.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * size
    columns[0] = np.cumsum(columns[0])
    return tuple(columns)


STRETCHES = ("name long, context long, doc long, print long, start long, count int, lead int, copied boolean, "
             "from_doc long, from_start long")


def stretches(docs: DataFrame, letters: Callable[[bytes], np.ndarray], length: int, anchor: int,
              within: bool) -> DataFrame:
    """What can be said of windows by their stretches: rows of ``STRETCHES``.

    ``docs`` has ``_doc`` (long), ``_print`` (long, tells rows of one id apart) and ``_text``. With ``copied``
    every window of the stretch also starts earlier: in a document of smaller id or, if ``within``, earlier
    in the same one, and ``from_doc`` and ``from_start`` say where one such stretch starts. Without, the stretch shares its anchor string with other contexts, and its windows have
    to be compared one by one. Windows in no returned stretch start nowhere earlier.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(parts, total // BUCKET_BYTES)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(length, anchor, buckets, within)

        def sent():
            rows = list(held.flush())
            for at in range(0, len(rows), 256):
                bucket, state, data = zip(*rows[at:at + 256], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), pa.array(state, pa.int32()), pa.array(data, pa.binary())],
                    names=["bucket", "state", "run"])
        for batch in batches:
            for part in pieces(batch, 2, SLICE):
                for doc, print_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                             part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    held.add(doc, print_, letters(text))
                if held.full():
                    yield from sent()
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 2):
            found = [unpacked(d) for d in run.column(2).to_pylist()]
            rows = tuple(np.concatenate(c) for c in zip(*found, strict=True))
            state = run.column(1)[0].as_py()
            if state != OPEN:
                yield told(rows[:6], np.full(len(rows[0]), state == COPIED), *rows[6:])
                continue
            rows, first = in_order(rows)
            copied = repeated(rows, first, within)
            name = rows[0]
            begin = np.nonzero(np.concatenate(([True], name[1:] != name[:-1])))[0]
            several = np.add.reduceat(first.astype(np.int64), begin) > 1
            shared = np.repeat(several, np.diff(np.append(begin, len(name))))
            keep = np.nonzero(copied | shared)[0]
            if len(keep):
                head = np.nonzero(first)[0][np.cumsum(first) - 1][keep]
                yield told(tuple(c[keep] for c in rows), copied[keep], rows[2][head], rows[4][head])

    def told(rows, copied, from_doc, from_start) -> pa.RecordBatch:
        name, context, doc, print_, start, shape = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(copied, 0, name.view(np.int64))), pa.array(context.view(np.int64)), pa.array(doc),
             pa.array(print_), pa.array(start), pa.array(shape.astype(np.int32) // 64),
             pa.array(shape.astype(np.int32) % 64), pa.array(copied), pa.array(from_doc), pa.array(from_start)],
            names=[c.split()[0] for c in STRETCHES.split(", ")])

    return (docs.select("_doc", "_print", "_text").mapInArrow(released(gather), "bucket long, state int, run binary")
            .repartition(parts, "bucket").sortWithinPartitions("bucket", "state").mapInArrow(released(merge), STRETCHES))
