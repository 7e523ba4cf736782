"""Temperature mixing of sources, realised as budgeted permutations of blocks.

A source with share p of all tokens gets weight p^a / sum p^a. The exponent a is found by bisection: the
least one in [0, 1] whose repetition (tokens drawn from a source over tokens it has) keeps within a limit
everywhere, or the one at which the weights' entropy meets a target. A source's budget is drawn as whole
passes over its documents and one part of a pass; every pass runs over the source's blocks in its own
pseudo-random order and over each block's documents in theirs, until the budget is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winledger.llm.shared import cut, table, text_bytes, utf8

REPEATS = 1.25
BLOCK_DOCS = 2048  # documents a block holds on average
STEPS = 40  # halvings of the exponent's interval
SEED = 17
_FAN = 4  # halvings decided by one pass over the sources


def token_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                 text_col: str = "text") -> DataFrame:
    """``_id``, ``_source`` and ``tokens``: the words between ASCII blanks of each row's whole text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([len(t.split()) for t in text_bytes(batch.column(2))], pa.int64())],
                names=["_id", "_source", "tokens"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, source_col)}
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                       utf8(text_col).alias("_text")).mapInArrow(
        count, f"_id {kinds[id_col]}, _source {kinds[source_col]}, tokens long")


def _met(a: float, over: float, repeats: float | None, entropy: float | None, n: int):
    """Whether exponent ``a`` is large enough, as an aggregate over the sources' shares ``p``."""
    total = F.sum(F.pow("p", F.lit(a)))
    if repeats is not None:
        return F.max(F.pow("p", F.lit(a - 1))) / total * over <= repeats
    level = F.log(total) - a * F.sum(F.pow("p", F.lit(a)) * F.log("p")) / total
    return level <= entropy * F.log(F.lit(float(n)))


def exponent(shares: DataFrame, over: float, repeats: float | None = REPEATS, entropy: float | None = None,
             steps: int = STEPS) -> float:
    """The bisected exponent for shares ``p``; ``over`` is the budget over all tokens.

    Bisection needs one aggregate a step; here one aggregate tries the points of ``_FAN`` steps at once.
    Where no exponent in [0, 1] meets the goal the result is 1, the sources' own shares.
    """
    n = shares.count()
    low, high, left = 0.0, 1.0, steps
    while left and n:
        depth = min(_FAN, left)
        points = [low + (high - low) * k / 2**depth for k in range(1, 2**depth)]
        met = shares.agg(*(_met(a, over, repeats, entropy, n).alias(f"m{k}") for k, a in enumerate(points))).first()
        for _ in range(depth):
            middle = (low + high) / 2
            if met[points.index(middle)]:
                high = middle
            else:
                low = middle
        left -= depth
    return high


def _order(*parts):
    return F.md5(F.concat_ws("|", *(p if not isinstance(p, int) else F.lit(str(p)) for p in parts)))


def mix(docs: DataFrame, budget: int | None = None, repeats: float | None = REPEATS,
        entropy: float | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """One row for every document drawn: id, source, ``n_tokens``, ``epoch`` and its place in the mix.

    ``budget`` is in tokens (default: as many as the documents have); give a limit of ``repeats`` or a target
    ``entropy`` as a share of its maximum. ``block_rank`` orders the blocks of a source's pass, ``doc_rank``
    the documents of a block. A source ends at the last document that fits in its budget. Documents without
    words are never drawn; a null source is a source of its own; repeated rows are drawn each for itself.
    """
    if (repeats is None) == (entropy is None):
        raise ValueError("give either a limit of repeats or a target entropy")
    read = cut(token_counts(docs, id_col, source_col, text_col).where("tokens > 0"))
    sources = cut(read.groupBy("_source").agg(F.sum("tokens").alias("has"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("has")).first()[0] or 0
    budget = total if budget is None else budget
    shares = sources.select((F.col("has") / F.lit(total).cast("double")).alias("p"))
    a = exponent(shares, budget / total if total else 1.0, repeats, entropy)
    power = F.pow(F.col("has") / F.lit(total).cast("double"), F.lit(a))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = sources.select(
        F.col("_source").alias("_s"), "has", F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"),
        F.floor(power / F.lit(norm) * F.lit(float(budget))).cast("long").alias("due"))
    planned = (read.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
               .withColumn("_name", F.coalesce(F.col("_id").cast("string"), F.lit("")))
               .withColumn("block", F.pmod(F.conv(F.substring(_order(seed, F.col("_name")), 1, 8), 16, 10).cast("long"),
                                           F.col("blocks"))))
    blocks = planned.groupBy("_source", "block").agg(
        F.sum("tokens").alias("size"), F.first("has").alias("has"), F.first("due").alias("due"))
    passes = (blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("due div has"))))
              .withColumn("left", F.least(F.col("has"), F.col("due") - F.col("epoch") * F.col("has"))))
    shuffled = Window.partitionBy("_source", "epoch").orderBy(_order(seed, F.col("epoch").cast("string"),
                                                                     F.col("block").cast("string")))
    taken = (passes.withColumn("block_rank", F.row_number().over(shuffled))
             .withColumn("before", F.sum("size").over(shuffled) - F.col("size"))
             .where("before < left")
             .select(F.col("_source").alias("_s2"), F.col("block").alias("_b2"), "epoch", "block_rank",
                     (F.col("left") - F.col("before")).alias("room")))
    inside = Window.partitionBy("_source", "epoch", "block").orderBy(
        _order(seed, F.col("epoch").cast("string"), F.col("_name")), "_name", "tokens")
    return (planned.join(taken, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_b2")))
            .withColumn("doc_rank", F.row_number().over(inside))
            .withColumn("used", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .where("used <= room")
            .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col),
                    F.col("tokens").alias("n_tokens"), "epoch", F.col("block_rank").cast("long").alias("block_rank"),
                    F.col("doc_rank").cast("long").alias("doc_rank")))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), read AS (SELECT * FROM counted WHERE tokens > 0),
sources AS (
  SELECT source, sum(tokens)::BIGINT AS has, count(*) AS docs, sum(tokens) / (SELECT sum(tokens) FROM read) AS p
  FROM read GROUP BY source
), bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN met THEN low ELSE (low + high) / 2 END, CASE WHEN met THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) <= {REPEATS} AS met
        FROM bisect, sources WHERE i < {STEPS} GROUP BY i, low, high)
), exponent AS (SELECT high AS a FROM bisect WHERE i = {STEPS}),
plan AS (
  SELECT source, has, ceil(docs / {BLOCK_DOCS}.0)::BIGINT AS blocks,
         floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM sources, exponent) * (SELECT sum(has) FROM sources))::BIGINT AS due
  FROM sources, exponent
),
planned AS (
  SELECT r.*, has, due, ('0x' || substr(md5('{SEED}|' || name), 1, 8))::BIGINT % blocks AS block
  FROM read r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
), blocks AS (
  SELECT source, block, sum(tokens)::BIGINT AS size, any_value(has) AS has, any_value(due) AS due
  FROM planned GROUP BY source, block
), passes AS (
  SELECT *, least(has, due - epoch * has) AS room
  FROM (SELECT *, unnest(range(0, due // has + 1)) AS epoch FROM blocks)
), ranked AS (
  SELECT *, row_number() OVER w AS block_rank, sum(size) OVER w - size AS before
  FROM passes
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('{SEED}|' || epoch::VARCHAR || '|' || block::VARCHAR))
), drawn AS (
  SELECT p.doc_id, p.source, p.name, p.tokens, r.epoch, r.block, r.block_rank, r.room - r.before AS room
  FROM planned p JOIN ranked r ON p.source IS NOT DISTINCT FROM r.source AND p.block = r.block
  WHERE r.before < r.room
), placed AS (
  SELECT *, row_number() OVER w AS doc_rank,
         sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS used
  FROM drawn
  WINDOW w AS (PARTITION BY source, epoch, block
               ORDER BY md5('{SEED}|' || epoch::VARCHAR || '|' || name), name, tokens)
)
SELECT doc_id, source, tokens::BIGINT AS n_tokens, epoch::BIGINT AS epoch, block_rank::BIGINT AS block_rank,
       doc_rank::BIGINT AS doc_rank
FROM placed WHERE used <= room
"""
