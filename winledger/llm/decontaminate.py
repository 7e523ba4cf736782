"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

Every run of ``window`` words of an item is a pattern; an item of fewer words is one pattern. For each
pattern length a table gives, for a block of two words, how far the search may move on before any pattern
could end. Where it may not move, the block's bucket lists the patterns that end with it, keyed by their
first words, and a direct comparison decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import pieces, stored, table, text_bytes, utf8

WINDOW = 10
BLOCK = 2
ITEM_BYTES = 4 << 20  # of item texts that one broadcast carries; more items take more passes
_PIECE = 4 << 20
# Letters and digits of ASCII in lower case and every byte of other characters; the rest is a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Patterns:
    """Shift and bucket tables, by pattern length, for the windows of some items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.owners: list[tuple[int, ...]] = []
        self.by_length: dict[int, tuple[int, int, dict, dict]] = {}
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                owners.setdefault(tuple(words[at:at + size]), set()).add(item)
        for pattern, ids in owners.items():
            size = len(pattern)
            block = min(BLOCK, size)
            _, _, shift, buckets = self.by_length.setdefault(size, (size, block, {}, {}))
            for end in range(block, size + 1):
                key = pattern[end - block:end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(pattern[-block:], {}).setdefault(pattern[:block], []).append(
                (pattern, len(self.owners)))
            self.owners.append(tuple(ids))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, words) of every occurrence, and the ids of the items that have one."""
        spans, found = [], set()
        n = len(words)
        for size, block, shift, buckets in self.by_length.values():
            far = size - block + 1
            end = size
            while end <= n:
                key = tuple(words[end - block:end])
                move = shift.get(key, far)
                if move:
                    end += move
                    continue
                at = end - size
                for pattern, owner in buckets[key].get(tuple(words[at:at + block]), ()):
                    if tuple(words[at:end]) == pattern:
                        spans.append((at, size))
                        found.update(self.owners[owner])
                end += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as (first word, words), in order."""
    out: list[list[int]] = []
    for at, size in sorted(spans):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + size)
        else:
            out.append([at, at + size])
    return [(a, b - a) for a, b in out]


_built: dict[tuple, Patterns] = {}  # one entry: the tables of the items this worker last saw


def _tables(items, window: int) -> Patterns:
    name, rows = items.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Patterns(rows, window)
    return _built[name, window]


_SPANS = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32())]))
_FOUND = "n_words long, spans array<struct<at:int,words:int>>, items array<long>"


def _searched(docs: DataFrame, items, window: int) -> DataFrame:
    """``_id``, ``_print`` with the words, hit spans and items of each row's text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _tables(items, window)
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                counts, spans, found = [], [], []
                for text in text_bytes(part.column(2)):
                    words = words_of(text)
                    hits, ids = patterns.search(words)
                    counts.append(len(words))
                    spans.append([{"at": a, "words": n} for a, n in merged(hits)])
                    found.append(sorted(i for i in ids if i is not None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPANS),
                     pa.array(found, pa.list_(pa.int64()))],
                    names=["_id", "_print", "n_words", "spans", "items"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_print", "_text").mapInArrow(scan, f"_id {kind}, _print long, {_FOUND}")


def _passes(items: DataFrame, item_col: str, text_col: str, item_bytes: int) -> Iterator:
    """The items, broadcast in passes of about ``item_bytes``: a name for the pass, and its (id, text) rows."""
    spark = items.sparkSession
    texts = items.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(-(-2 * total // item_bytes)) if total > item_bytes else 1
    for k in range(passes):
        mine = texts if passes == 1 else texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        rows = sorted(((r.item, r.text.encode()) for r in mine.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast((hashlib.sha256(repr(rows).encode()).hexdigest(), rows))


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``id_col``, ``n_words``, ``spans`` (merged hit runs of words) and ``items`` for every row of ``docs``.

    Item texts are sent to the tasks in passes of at most ``item_bytes`` (one larger item has a pass alone);
    the documents are read once per pass and the passes' hits are merged. Null and empty texts have no words.
    Items with a null text have no windows; an item with a null id marks words and is not among ``items``. Rows
    that share an item id count as one item. Rows that share a document id are searched and returned each for itself.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(utf8(text_col)).alias("_print"),
                       utf8(text_col).alias("_text"))
    found = None
    for piece in _passes(items, item_col, item_text_col, item_bytes):
        one = _searched(read, piece, window)
        if found is None:
            found = one
            continue
        more = one.where(F.size("spans") > 0).distinct().select(
            F.col("_id").alias("_id2"), F.col("_print").alias("_print2"), F.col("spans").alias("_spans2"),
            F.col("items").alias("_items2"))
        found = found.join(more, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_print") == F.col("_print2")),
                           "left").select(
            "_id", "_print", "n_words",
            F.concat("spans", F.coalesce("_spans2", F.array().cast("array<struct<at:int,words:int>>"))).alias("spans"),
            F.array_sort(F.array_union("items", F.coalesce("_items2", F.array().cast("array<long>")))).alias("items"))
    return found.select(F.col("_id").alias(id_col), "n_words", _union_of("spans").alias("spans"), "items")


def _union_of(spans: str):
    """Overlapping or touching spans as one, in columns."""
    part = "struct<at:int,words:int>"
    end = lambda s: s["at"] + s["words"]
    grown = lambda done, s: F.when(
        (F.size(done) > 0) & (s["at"] <= end(F.element_at(done, -1))),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["at"].alias("at"),
            (F.greatest(end(s), end(F.element_at(done, -1))) - F.element_at(done, -1)["at"]).alias("words")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.when(F.size(spans) < 2, F.col(spans)).otherwise(F.aggregate(
        F.array_sort(spans), F.array().cast(f"array<{part}>"), grown))


def _id_digest(items: str):
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        _id_digest("items").alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item's window occurs, with their columns; each is judged by its own text.

    With more than one pass of items, the rows that are left are written between passes.
    """
    at = docs.columns.index(text_col)

    def keeping(items_sent):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = _tables(items_sent, window)
            for batch in batches:
                for part in pieces(batch, at, _PIECE):
                    hit = [bool(patterns.search(words_of(t))[0]) for t in text_bytes(part.column(at))]
                    yield part.filter(pa.array([not h for h in hit], pa.bool_()))
        return keep

    left = None
    for piece in _passes(items, item_col, item_text_col, item_bytes):
        left = (docs if left is None else stored(left)).mapInArrow(keeping(piece), docs.schema)
    return left


SQL = r"""
WITH lowered AS (
  SELECT doc_id, rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p0:p0 + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p0 FROM item_words WHERE len(w) > 0)
), places AS (
  SELECT rid, p0, size, array_to_string(w[p0:p0 + size - 1], ' ') AS k
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p0
        FROM lowered, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT rid, p0, p.size, item_id FROM places p JOIN windows x ON p.size = x.size AND p.k = x.k
), covered AS (
  SELECT rid, count(DISTINCT pos) AS n_hit
  FROM (SELECT rid, unnest(range(p0, p0 + size)) AS pos FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
