"""How text filters interact: what each one removes in every order of application.

Each document passes or fails each of five filters, so the documents of a part fill a 2x2x2x2x2 table of
counts. Whatever a step of an order says of its filter is a contraction of that table: along every axis a
selector takes the documents that pass, those that fail, or all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import stored, table, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return [F.size(words) < 100,
            100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
            text.rlike("[#$%&*|]")]


def part_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """``part``, ``mask`` (a bit for each failed filter, A the highest), ``n``, ``good`` and ``toxic`` documents.

    A null text is empty, a null part is the empty string. Each row counts, repeated ids and rows too. Rows with
    a null id never fail E and have no label; a label that occurs with 1 in any row of ``labels`` counts as 1.
    Rows are combined by text, id, part and failures before anything is joined, so copies and repeated rows
    cost one row for each id, and E is decided by a partial minimum and a join on text and id.
    """
    text = utf8(text_col)
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"),
                       text.alias("_text"))
    failed = read.select("_id", "_part", F.unhex(F.sha2("_text", 256)).alias("_digest"),
                         sum(f.cast("int") * (16 >> k) for k, f in enumerate(text_failures(F.col("_text")))).alias("_mask"))
    facts = stored(failed.groupBy("_digest", "_id", "_part", "_mask").agg(F.count("*").alias("_n")))
    firsts = facts.groupBy(F.col("_digest").alias("_same")).agg(F.min("_id").alias("_first"))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")))
    told = (facts.join(firsts, (F.col("_digest") == F.col("_same")) & (F.col("_id") == F.col("_first")), "left")
            .join(marks, F.col("_id") == F.col("_labelled"), "left"))
    repeats = (F.col("_id").isNotNull() & F.col("_first").isNull()).cast("int")
    return told.groupBy(F.col("_part").alias("part"), (F.col("_mask") + repeats).alias("mask")).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))


def _selectors() -> dict[str, np.ndarray]:
    """For every order and step and each question, which side of each axis is taken: (order and step, axis, side)."""
    asked: dict[str, list] = {"kept": [], "removed": [], "failing": [], "only": []}
    for order in ORDERS:
        for step, own in enumerate(order):
            before, upto = order[:step], order[:step + 1]
            asked["kept"].append([PASS if f in upto else ALL for f in FILTERS])
            asked["removed"].append([FAIL if f == own else PASS if f in before else ALL for f in FILTERS])
            asked["failing"].append([FAIL if f == own else ALL for f in FILTERS])
            asked["only"].append([FAIL if f == own else PASS for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in asked.items()}


SELECTORS = _selectors()


def contracted(tensor: np.ndarray, selector: np.ndarray) -> np.ndarray:
    """(order and step, count) of a (count, 2, 2, 2, 2, 2) tensor."""
    return np.einsum("qabcde,ra,rb,rc,rd,re->rq", tensor, *(selector[:, k] for k in range(len(FILTERS))),
                     optimize=True)


def audited(tensor: np.ndarray) -> pd.DataFrame:
    """The rows of one part, without its name, from its counts of documents, good ones and toxic ones."""
    took = {k: contracted(tensor, s) for k, s in SELECTORS.items()}
    rows = pd.DataFrame({
        "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)),
        "kept": took["kept"][:, 0], "removed": took["removed"][:, 0],
        "redundant": took["failing"][:, 0] - took["removed"][:, 0], "unique_fails": took["only"][:, 0],
        "good_lost": took["removed"][:, 1], "toxic_lost": took["removed"][:, 2]})
    own = np.array([f for order in ORDERS for f in order])
    rows["shapley"] = rows.groupby(own)["removed"].transform("sum")
    return rows


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; an empty table has no part and gives no row.

    A part comes to its task as at most 32 counts.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, counts in zip(rows["part"], rows["counts"], strict=True):
                tensor = np.zeros((3, 32), np.int64)
                for c in counts:
                    tensor[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                found = audited(tensor.reshape(3, 2, 2, 2, 2, 2))
                found.insert(0, "part", name)
                yield found

    counts = part_counts(docs, labels, id_col, text_col, part_col)
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInPandas(
        part, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [(len(words) < 100)::INT,
          (100 * len(list_distinct(words)) < 80 * len(words))::INT,
          (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT,
          regexp_matches(text, '[#$%&*|]')::INT,
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT] AS failed
  FROM texts t LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, x AS step FROM orders, f),
told AS (
  SELECT part, o, step, o[step] AS own, n, good, toxic, failed[o[step]] = 1 AS fails,
         len(list_filter(o[:step - 1], lambda k: failed[k] = 1)) > 0 AS gone, list_sum(failed) AS fs
  FROM counts, steps),
found AS (
  SELECT part, o, step, any_value(own) AS own,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
         coalesce(sum(n) FILTER (fails AND fs = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM told GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found
"""
