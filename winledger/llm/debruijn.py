"""Repeated passages by a compacted de Bruijn graph of words.

Every run of ``window`` words is an edge from its first to its last ``window - 1`` words. Edges that overlap
and share their anchor (``windows``) stand together as one stretch, labelled by the hash of all its words.
Repeated edges, whole stretches or single ones, keep the coordinates of an earlier occurrence. Where an edge
is always followed by the same edge and that one always preceded by it, joins compact the two; an occurrence
of a path without branches is then one row, as long as its source coordinates advance with its own, which
checks that one long passage was copied as it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winledger.llm import windows
from winledger.llm.shared import released, sized_pieces, stored, table
from winledger.llm.suffixes import once, opened, searched, told_apart, without

WINDOW = 20
ANCHOR = 8
_PIECE = 2 << 20


def _single_edges(read: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Every edge of ``shared`` stretches: two hashes of its words, where it starts, and where it starts first in
    its own document."""
    lists = shared.groupBy(F.col("doc").alias("_d"), F.col("print").alias("_p")).agg(
        F.collect_list(F.struct("start", "count")).alias("_list"))
    held = read.join(lists, (F.col("_doc") == F.col("_d")) & (F.col("_print") == F.col("_p")), "left").select(
        "_list", *read.columns)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for part in sized_pieces(batch, 4, _PIECE):
                out = []
                for places, doc, print_, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    letters = windows.word_letters(large.decompress(text))
                    at = np.sort(np.concatenate([p["start"] + np.arange(p["count"]) for p in places]))
                    one, two = (windows.Hashes(letters, b).of(at, at + window) for b in windows.BASES)
                    order = np.lexsort((at, two, one))
                    new = np.ones(len(at), bool)
                    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                    own = np.empty_like(at)
                    own[order] = at[order][new][np.cumsum(new) - 1]
                    out.append((one, two, np.full(len(at), doc), np.full(len(at), print_, np.int64), at, own))
                if out:
                    a, b, doc, print_, at, own = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(print_),
                         pa.array(at), pa.array(own)], names=["label", "check", "doc", "print", "start", "own"])

    return held.mapInArrow(released(take), "label long, check long, doc long, print long, start long, own long")


def _repeated_edges(edges: DataFrame) -> DataFrame:
    """Single edges that also start earlier, with the earliest place in a smaller document or in their own."""
    first = edges.groupBy(F.col("label").alias("_l"), F.col("check").alias("_c")).agg(
        F.min(F.struct("doc", "start")).alias("_first"), F.max("doc").alias("_last"), F.max(F.col("start") - F.col("own"))
        .alias("_inside")).where((F.col("_first.doc") < F.col("_last")) | (F.col("_inside") > 0))
    other = F.col("doc") > F.col("_first.doc")
    return (edges.join(first, (F.col("label") == F.col("_l")) & (F.col("check") == F.col("_c")))
            .where(other | (F.col("start") > F.col("own")))
            .select("label", "doc", "print", "start", F.lit(1).alias("count"),
                    F.when(other, F.col("_first.doc")).otherwise(F.col("doc")).alias("from_doc"),
                    F.when(other, F.col("_first.start")).otherwise(F.col("own")).alias("from_start")))


def compacted(units: DataFrame) -> DataFrame:
    """Occurrences of unbranched paths: ``doc``, ``print``, ``start``, ``count`` of edges, source and ``label``.

    ``units`` are occurrences of repeated stretches. A link joins a unit to the one that starts where it ends.
    It is unbranched if its left label has one right neighbour and its right label one left neighbour, over
    all documents; both are found by partial minima and maxima and joined back to the links.
    """
    here = Window.partitionBy("doc", "print").orderBy("start")
    lined = units.withColumn("_before", F.lag(F.struct("label", "start", "count", "from_doc", "from_start")).over(here))
    meets = F.col("_before.start") + F.col("_before.count") == F.col("start")
    lined = lined.withColumn("_left", F.when(meets, F.col("_before.label")))
    links = lined.where("_left IS NOT NULL")
    out = (links.groupBy(F.col("_left").alias("_from")).agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
           .select("_from", (F.col("_a") == F.col("_b")).alias("_one_out")))
    into = (links.groupBy(F.col("label").alias("_to")).agg(F.min("_left").alias("_a"), F.max("_left").alias("_b"))
            .select("_to", (F.col("_a") == F.col("_b")).alias("_one_in")))
    told = lined.join(out, F.col("_left") == F.col("_from"), "left").join(into, F.col("label") == F.col("_to"), "left")
    same_source = ((F.col("_before.from_doc") == F.col("from_doc"))
                   & (F.col("from_start") - F.col("_before.from_start") == F.col("start") - F.col("_before.start")))
    goes_on = F.coalesce(F.col("_left").isNotNull() & F.col("_one_out") & F.col("_one_in") & same_source, F.lit(False))
    numbered = told.withColumn("_head", (~goes_on).cast("int")).withColumn(
        "_path", F.sum("_head").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "print", "_path").agg(
        F.min("start").alias("start"), F.sum("count").alias("count"), F.min("from_doc").alias("from_doc"),
        F.min("from_start").alias("from_start"), F.min_by("label", "start").alias("label")).drop("_path")


def passages(docs: DataFrame, read: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             window: int = WINDOW, anchor: int = ANCHOR,
             apart: tuple[bool, bool] | None = None) -> DataFrame:
    """Repeated passages: ``doc``, ``print``, ``start`` and ``count`` of edges (the passage has ``window - 1``
    words more), ``from_doc`` and ``from_start`` of an earlier occurrence, and the path's first ``label``.

    ``read`` is ``suffixes.opened(docs, ...)``, ``apart`` as there. An edge is repeated if it starts in a document of
    smaller id or earlier in the same one. Rows without id or text take no part; rows that share an id with different texts
    take nothing from one another, and identical rows are treated alike.
    """
    several, repeated = apart or told_apart(docs, id_col, text_col)
    found = stored(windows.stretches(
        searched(docs, id_col, text_col, several, repeated),
        windows.word_letters, window, anchor, within=True).drop("name", "lead"))
    columns = ["label", "doc", "print", "start", "count", "from_doc", "from_start"]
    whole = found.where("copied").withColumnRenamed("context", "label").select(columns)
    single = _repeated_edges(stored(_single_edges(once(read, repeated), found.where("NOT copied"), window)))
    return compacted(stored(whole.unionByName(single.select(columns)).distinct()))


def _digest(window: int):
    def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        words = text.split()
        kept, at, gone = [], 0, 0
        for start, stop in spans:
            kept += words[at:start]
            at, gone = stop, gone + stop - start
        kept += words[at:]
        return len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()
    return finish


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = told_apart(docs, "doc_id", "text")
    read = opened(docs, "doc_id", "text", [], apart)
    found = passages(docs, read, apart=apart)
    spans = found.select("doc", "print", "start", (F.col("count") + (WINDOW - 1)).cast("long").alias("length"))
    return without(docs, read, spans, "doc_id", [], "n_words long, n_removed long, kept_sha256 string",
                   _digest(WINDOW))


SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT rid, doc_id, p0, array_to_string(w[p0:p0 + 19], ' ') AS k
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS p0 FROM read WHERE len(w) >= 20 AND doc_id IS NOT NULL)
), marked AS (
  SELECT rid, p0, doc_id > min(doc_id) OVER (PARTITION BY k)
    OR p0 > min(p0) OVER (PARTITION BY k, rid) AS again
  FROM windows
), gone AS (
  SELECT rid, list(DISTINCT pos) AS pos
  FROM (SELECT rid, unnest(range(p0, p0 + 20)) AS pos FROM marked WHERE again) GROUP BY rid
), kept AS (
  SELECT rid, list(x ORDER BY i) AS words
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM read) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid, unnest(pos) AS p FROM gone) g WHERE g.rid = a.rid AND g.p = a.i)
  GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256
FROM read LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
