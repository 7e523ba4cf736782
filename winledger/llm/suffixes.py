"""Repeated byte strings by externally sorted, induced suffixes with their common prefixes.

Suffixes are first told apart at anchors only (``windows``): tuples of anchor name, context, document and
place are sorted outside memory by Spark's shuffle and merged by name. A name that has several contexts
goes on with the bytes around it: its suffixes are sorted from the anchor with the lengths of their common
prefixes, and the order of the suffixes that start one byte further left is induced from it, byte by byte,
with the common prefixes carried along. A run of suffixes whose common prefixes reach ``length`` is a set of
equal strings. Names with too many contexts for one sort are compared string by string in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm import windows
from winledger.llm.shared import (
    cut,
    pieces,
    released,
    runs,
    shuffle_parts,
    sized_pieces,
    small_batches,
    stored,
    table,
    text_bytes,
    unused,
    utf8,
)

LENGTH = 50
ANCHOR = 20
SORTED_TOGETHER = 1 << 13  # contexts of one name that one task sorts; more are compared in a shuffle
_PIECE = 4 << 20
_SPANS = "doc long, print long, start long, length long"


def opened(docs: DataFrame, id_col: str, text_col: str, extra: list[str],
           apart: tuple[bool, bool] | None = None) -> DataFrame:
    """``_doc``, ``_print`` (tells rows of one id apart), the compressed text ``_zip``, its ``_size`` when opened, and
    ``extra`` as ``_x0``... ``apart`` is ``told_apart(docs, ...)`` where that is known already.

    Both joins with texts read this frame whole, so that one shuffle of it serves them.
    """
    small_batches(docs.sparkSession)
    text = utf8(text_col)
    several, _ = apart or told_apart(docs, id_col, text_col)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                texts = text_bytes(part.column(2))
                zipped = pa.array([small.compress(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), zipped, pa.array([len(t) for t in texts], pa.int64()), *part.columns[3:]],
                    names=names)

    more = [f"_x{i}" for i in range(len(extra))]
    names = ["_doc", "_print", "_zip", "_size", *more]
    kinds = "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for x, c in zip(more, extra, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("_doc"), _print(text, several), text.alias("_text"),
                       *(F.col(c).alias(x) for x, c in zip(more, extra, strict=True))).mapInArrow(
        released(shrink), f"_doc long, _print long, _zip binary, _size long{kinds}")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[bool, bool]:
    """Whether an id has several texts, and whether a row with an id repeats."""
    rows = (docs.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(utf8(text_col)).alias("_hash"))
            .agg(F.count("*").alias("_n")))
    found = rows.groupBy("_doc").agg(F.count("*").alias("_texts"), F.max("_n").alias("_n")).agg(
        F.max("_texts"), F.max("_n")).first()
    return (found[0] or 0) > 1, (found[1] or 0) > 1


def _print(text, several: bool):
    """The whole hash of the text, or nothing to store where every id has one text."""
    return (F.xxhash64(text) if several else F.lit(0).cast("long")).alias("_print")


def searched(docs: DataFrame, id_col: str, text_col: str, several: bool, repeated: bool) -> DataFrame:
    """``_doc``, ``_print`` and ``_text`` of the rows with an id, each id's texts once."""
    text = utf8(text_col)
    return once(docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_doc"), _print(text, several), text.alias("_text")), repeated)


def once(rows: DataFrame, repeated: bool) -> DataFrame:
    return rows.dropDuplicates(["_doc", "_print"]) if repeated else rows


def _with_lists(read: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Each row of ``read`` with its list, null where there is none."""
    keyed = lists.select(F.col("doc").alias("_d"), F.col("print").alias("_p"), F.col(name).alias("_list"))
    return read.join(keyed, (F.col("_doc") == F.col("_d")) & (F.col("_print") == F.col("_p")), "left").select(
        "_list", *read.columns)


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)


def _common_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low..high]`` for each pair, from minima over powers of two."""
    tables, size = [values], 1
    while size * 2 <= len(values):
        tables.append(np.minimum(tables[-1][:-size], tables[-1][size:]))
        size *= 2
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        some = level == k
        out[some] = np.minimum(tables[k][low[some]], tables[k][high[some] - (1 << int(k)) + 1])
    return out


def induced_repeats(contexts: list[bytes], count: np.ndarray, lead: np.ndarray, doc: np.ndarray,
                    length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window that also starts in a smaller document, within the rows given.

    Row i's windows start at bytes 0 to ``count[i] - 1`` of its context; its anchor stands ``lead[i]`` bytes
    after the last one's start.
    """
    anchor = count - 1 + lead
    right = _matrix([c[a:a + length] for c, a in zip(contexts, anchor, strict=True)], length)
    widest = int(anchor.max())
    left = _matrix([c[:a][::-1] for c, a in zip(contexts, anchor, strict=True)], max(1, widest))
    words = np.zeros((len(contexts), -(-length // 8) * 8), np.uint8)
    words[:, :length] = right
    order = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])
    differ = right[order[1:]] != right[order[:-1]]
    common = np.zeros(len(order), np.int32)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    found_row, found_window = [], []
    for step in range(widest + 1):
        if step:
            stay = np.nonzero(anchor[order] >= step)[0]
            if not len(stay):
                break
            byte = left[order[stay], step - 1]
            sort = np.argsort(byte, kind="stable")
            place = stay[sort]
            after = np.zeros(len(place), np.int32)
            same = byte[sort][1:] == byte[sort][:-1]
            if same.any():
                after[1:][same] = np.minimum(
                    1 + _common_minima(common, place[:-1][same] + 1, place[1:][same]), length)
            order, common = order[place], after
        owns = (lead[order] <= step) & (anchor[order] >= step)
        if not owns.any():
            continue
        group = np.cumsum(common < length)[owns]
        rows = order[owns]
        begin = np.nonzero(np.diff(group, prepend=-1))[0]
        least = np.minimum.reduceat(doc[rows], begin)
        hit = doc[rows] > np.repeat(least, np.diff(np.append(begin, len(rows))))
        found_row.append(rows[hit])
        found_window.append(anchor[rows[hit]] - step)
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_window)


def _joined(rows: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at consecutive places of a row as one span: row, place, length."""
    if not len(rows):
        return rows, places, places
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    begin = np.nonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1))))[0]
    end = np.append(begin[1:], len(rows)) - 1
    return rows[begin], places[begin], places[end] - places[begin] + length


def _contexts(read: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The bytes around the anchors of ``shared`` stretches."""
    lists = shared.groupBy("doc", "print").agg(
        F.collect_list(F.struct("name", "crowd", "start", "count", "lead")).alias("places"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for part in sized_pieces(batch, 4, _PIECE):
                places, doc, print_ = part.column(0), part.column(1), part.column(2)
                texts = [large.decompress(z) for z in part.column(3).to_pylist()]
                row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                flat = places.flatten()
                name, crowd, start, count, lead = (flat.field(i) for i in range(5))
                cut = [texts[r][a:a + n + length - 1] for r, a, n in
                       zip(row.tolist(), start.to_pylist(), count.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [name, crowd, pa.array(doc.to_numpy(zero_copy_only=False)[row]),
                     pa.array(print_.to_numpy(zero_copy_only=False)[row]), start, count, lead,
                     pa.array(cut, pa.binary())],
                    names=["name", "crowd", "doc", "print", "start", "count", "lead", "context"])

    return _with_lists(read, lists, "places").mapInArrow(
        released(take), "name long, crowd boolean, doc long, print long, start long, count int, lead int, context binary")


def repeats(docs: DataFrame, read: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            length: int = LENGTH, anchor: int = ANCHOR,
            apart: tuple[bool, bool] | None = None) -> DataFrame:
    """Spans of bytes covered by strings of ``length`` that also start in a document of smaller id.

    ``read`` is ``opened(docs, ...)``, ``apart`` as there. Rows of ``doc``, ``print`` (tells rows of one id with
    different texts apart), ``start`` and ``length``; spans may overlap. Rows without an id or text take no part.
    Rows that share an id are no smaller than each other, so they take nothing from one another.
    """
    parts = shuffle_parts(docs.sparkSession)
    several, repeated = apart or told_apart(docs, id_col, text_col)
    found = stored(windows.stretches(
        searched(docs, id_col, text_col, several, repeated),
        windows.byte_letters, length, anchor, within=False).drop("context", "from_doc", "from_start"))
    whole = found.where("copied").select(
        "doc", "print", "start", (F.col("count") + (length - 1)).cast("long").alias("length"))
    shared = found.where("NOT copied")
    crowds = cut(shared.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > SORTED_TOGETHER)
                 .select(F.col("name").alias("_name")))
    crowded = not crowds.isEmpty()
    shared = (shared.join(crowds, F.col("name") == F.col("_name"), "left") if crowded
              else shared.withColumn("_name", F.lit(None).cast("long")))
    shared = shared.select("name", F.col("_name").isNotNull().alias("crowd"), "doc", "print", "start", "count", "lead")
    contexts = _contexts(once(read, repeated), shared, length)

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for run in runs(batches, 1):
            if run.num_rows > 1:
                held.append(run)
                rows += run.num_rows
            if rows >= 1 << 15:
                yield decided(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield decided(pa.concat_tables(held))

    def decided(some: pa.Table) -> pa.RecordBatch:
        doc, print_, start, count, lead = (some.column(i).to_numpy().astype(np.int64) for i in range(1, 6))
        row, window = induced_repeats(some.column(6).to_pylist(), count, lead, doc, length)
        row, window, size = _joined(row, window, length)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(print_[row]), pa.array(start[row] + window),
             pa.array(size)], names=["doc", "print", "start", "length"])

    sorted_ = (contexts.where("NOT crowd").select("name", "doc", "print", "start", "count", "lead", "context")
               .repartition(parts, "name").sortWithinPartitions("name").mapInArrow(released(induce), _SPANS))
    spans = whole.unionByName(sorted_)
    if not crowded:
        return spans
    one_by_one = (contexts.where("crowd")
                  .select("doc", "print", "start", "context", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at"))
                  .select("doc", "print", (F.col("start") + F.col("at")).alias("start"),
                          F.expr(f"substring(context, at + 1, {length})").alias("string")))
    least = one_by_one.groupBy(F.col("string").alias("_string")).agg(
        F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_least < _most")
    return spans.unionByName(
        one_by_one.join(least, F.col("string") == F.col("_string")).where("doc > _least")
        .select("doc", "print", "start", F.lit(length).cast("long").alias("length")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Union of the spans as (start, stop), touching ones joined."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def without(docs: DataFrame, read: DataFrame, spans: DataFrame, id_col: str, extra: list[str], schema: str,
            finish: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    """Each row's id, ``extra`` columns and what ``finish`` makes of its bytes and its merged spans."""
    lists = spans.groupBy("doc", "print").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    names = [id_col, *extra]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    made_names = [x.split()[0] for x in schema.split(", ")]
    id_kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in sized_pieces(batch, 4, _PIECE):
                made = [finish(large.decompress(z), merged(s or [])) for z, s in
                        zip(part.column(3).to_pylist(), part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), *part.columns[5:], *(pa.array(c) for c in zip(*made, strict=True))],
                    names=[doc, *extra, *made_names])

    doc = unused([*names, *made_names], 1)[0]
    made = _with_lists(read, lists, "spans").mapInArrow(released(scan), kinds.replace(f"`{id_col}` {id_kind.simpleString()}",
                                                                            f"{doc} long", 1) + f", {schema}")
    return made.select(F.col(doc).cast(id_kind).alias(id_col), *extra, *made_names)


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, at = hashlib.sha256(), 0
    for start, stop in spans:
        kept.update(text[at:start])
        at = stop
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()


def _keep(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    """The text without its spans, which end at whole characters (one cut in two stays), and its bytes before."""
    kept, at = [], 0
    for start, stop in spans:
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        kept.append(text[at:start])
        at = max(at, stop)
    kept.append(text[at:])
    return b"".join(kept).decode(), len(text)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with repeated strings taken out of the text; rows left without text are dropped.

    Removal keeps whole characters: a character of which only some bytes are covered stays. Rows whose text
    was empty or null before stay as they are.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    empty, left, size = unused(docs.columns, 3)
    marked = docs.withColumn(empty, F.col(text_col).isNull())  # the text itself travels compressed
    apart = told_apart(docs, id_col, text_col)
    read = opened(marked, id_col, text_col, [*rest, empty], apart)
    spans = repeats(docs, read, id_col, text_col, length, apart=apart)
    cleaned = without(marked, read, spans, id_col, [*rest, empty], f"{left} string, {size} long", _keep)
    kept = F.when(~F.col(empty), F.col(left))
    return cleaned.where((F.col(size) == 0) | (F.col(left) != "")).select(
        *((kept if c == text_col else F.col(c)).alias(c) for c in docs.columns))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = told_apart(docs, "doc_id", "text")
    read = opened(docs, "doc_id", "text", [], apart)
    return without(docs, read, repeats(docs, read, apart=apart), "doc_id", [],
                   "n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest)
