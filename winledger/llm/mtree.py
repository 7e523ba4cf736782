"""Exact top-k by inner product: best-first search in an M-tree whose nodes are Spark partitions' pages.

The largest inner product is the nearest neighbour once every vector x gets one more component
sqrt(M^2 - |x|^2), M the greatest norm, and the query a zero: d^2 = |q|^2 + M^2 - 2 q.x. Vectors are
dealt to the nearest of a bounded set of routing objects; a node too large for one task is cut into parts.
Each part is paged: a page has a routing object, its covering radius, its distance to the node's routing
object, and every entry's distance to the page's. A query first visits its nearest node for a bound, then,
with that bound, every node its ball meets, best page first; the triangle inequality on stored distances
passes over pages and entries without computing theirs. Bounds leave room for rounding, and scores are
computed in whole numbers, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winledger.llm.shared import cut, runs, shuffle_parts, table

K = 10
SCALE = 1024
ROUTERS = 256  # routing objects of the top level, at most; they are broadcast
NODE_ROWS = 1024  # vectors for each routing object while there are fewer of these
PART_ROWS = 8192  # vectors one part of a node holds on average
PAGE_ROWS = 64
# Room for rounding, for each unit of the norms: a distance comes from the difference of squares, so one near
# zero is off by the root of their rounding.
_SLACK = 2e-6


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``dim``, ``vec`` (doubles holding floor(scale * x)) and ``square`` (its squared norm) of the rows
    that take part: those with an id and at least one component, all of them finite."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(values)  # nulls read as NaN
            ends = np.cumsum(sizes)
            starts = ends - sizes
            wrong = np.concatenate(([0], np.cumsum(bad)))
            ok = (sizes > 0) & (wrong[ends] == wrong[starts]) & ids.is_valid().to_numpy(zero_copy_only=False)
            places = np.nonzero(ok)[0]
            vectors = [np.floor(values[starts[i]:ends[i]] * scale).astype("<f8") for i in places]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(places)), pa.array(sizes[places], pa.int32()),
                 pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array([float(v @ v) for v in vectors], pa.float64())],
                names=["id", "dim", "vec", "square"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
                       ).mapInArrow(scan, "id long, dim int, vec binary, square double")


def _matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), dim)


def _raised(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors with the component that makes all norms sqrt(top)."""
    rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and of ``b``."""
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def dealt(vectors: DataFrame, routers: np.ndarray, top: float) -> DataFrame:
    """Every vector with its nearest routing object's number, the distance to it, and the part of the node."""
    dim = routers.shape[1]
    routes = vectors.sparkSession.sparkContext.broadcast(routers)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = _raised(routes.value, top)
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _apart(_raised(_matrix(batch.column(2), dim), top), high)
            node = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.astype(np.int32)), batch.column(0), batch.column(2)], names=["node", "id", "vec"])

    placed = vectors.mapInArrow(nearest, "node int, id long, vec binary")
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).withColumnRenamed(
        "node", "_node")
    return placed.join(F.broadcast(sizes), F.col("node") == F.col("_node")).select(
        "node", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vec")


class Pages:
    """The pages of one part of a node, and the search in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, router: np.ndarray, top: float):
        order = np.lexsort((*x.T[::-1], ids))  # repeated rows count once
        ids, x = ids[order], x[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)))
        ids, x = ids[new], x[new]
        high, router = _raised(x, top), _raised(router[None], top)
        n = max(1, len(ids) // PAGE_ROWS)
        picks = np.linspace(0, len(ids) - 1, n).astype(int)
        far = _apart(high, high[picks])
        page = far.argmin(axis=1)
        entry = far[np.arange(len(ids)), page]
        order = np.lexsort((entry, page))
        self.ids, self.x, self.entry = ids[order], x[order], entry[order]
        self.begin = np.searchsorted(page[order], np.arange(n + 1))
        self.routers = high[picks]
        self.radius = np.zeros(n)
        np.maximum.at(self.radius, page, entry)
        self.parent = _apart(self.routers, router)[:, 0]
        self.router = router
        self.slack = _SLACK * (1 + np.sqrt(top))

    def search(self, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, top: float, k: int):
        """For each query up to ``k`` (score, id) with a distance within its bound, best first."""
        raised = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        to_node = _apart(raised, self.router)[:, 0]
        square = np.einsum("ij,ij->i", queries, queries) + top
        for i, q in enumerate(queries):
            slack = _SLACK * (1 + np.sqrt(square[i])) + self.slack
            reach = bounds[i] + slack
            # Pages that the stored distance to the node's routing object rules out need no distance of their own.
            near = np.nonzero(np.abs(to_node[i] - self.parent) - self.radius <= reach)[0]
            far = _apart(raised[i:i + 1], self.routers[near])[0]
            least = far - self.radius[near]
            scores, ids = np.zeros(0), np.zeros(0, np.int64)
            for j in np.argsort(least, kind="stable"):
                if least[j] > reach:
                    break
                a, b = self.begin[near[j]], self.begin[near[j] + 1]
                hold = a + np.nonzero(np.abs(far[j] - self.entry[a:b]) <= reach)[0]
                hold = hold[self.ids[hold] != own[i]]
                if not len(hold):
                    continue
                scores = np.concatenate((scores, _products(self.x[hold], q)))
                ids = np.concatenate((ids, self.ids[hold]))
                if len(ids) >= k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    reach = min(reach, np.sqrt(max(square[i] - 2 * float(scores[-1]), 0)) + slack)
            best = np.lexsort((ids, -scores))[:k]
            yield i, scores[best], ids[best]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; in 64-bit integers where doubles could round."""
    if len(q) * max(1.0, float(np.abs(x).max()) * float(np.abs(q).max())) < 2**53:
        return x @ q
    return x.astype(np.int64) @ q.astype(np.int64)


def _searched(pages: DataFrame, asked: DataFrame, routers: np.ndarray, top: float, k: int, blocks: int) -> DataFrame:
    """``query``, ``vec``, ``id``, ``score`` of what each part finds; ``asked`` has node, part, id, vec, bound.

    Queries reach a part in blocks, so a task holds one part and one block at a time.
    """
    dim = routers.shape[1]
    routes = pages.sparkSession.sparkContext.broadcast(routers)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for run in runs(batches, 3):
            key = run.column(0)[0].as_py(), run.column(1)[0].as_py()
            x, ids = _matrix(run.column(4).to_pylist(), dim), run.column(3).to_numpy()
            if run.column(2)[0].as_py() < 0:
                at, tree = key, Pages(ids, x, routes.value[key[0]], top)
            elif key == at:
                found = list(tree.search(x, ids, run.column(5).to_numpy(), top, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(s), ids[i]) for i, s, _ in found]), pa.int64()),
                     pa.array([x[i].tobytes() for i, s, _ in found for _ in s], pa.binary()),
                     pa.array(np.concatenate([o for _, _, o in found]), pa.int64()),
                     pa.array(np.concatenate([s for _, s, _ in found]).astype(np.int64))],
                    names=["query", "vec", "id", "score"])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    both = pages.select("node", "part", F.lit(-1).alias("block"), "id", "vec", F.lit(0.0).alias("bound")).unionByName(
        asked.select("node", "part", block, "id", "vec", "bound"))
    return (both.repartition(shuffle_parts(pages.sparkSession), "node", "part")
            .sortWithinPartitions("node", "part", "block")
            .mapInArrow(find, "query long, vec binary, id long, score long"))


def _visits(queries: DataFrame, nodes: dict[int, tuple[int, float]], routers: np.ndarray, top: float,
            first: bool) -> DataFrame:
    """The parts each query visits: one of its nearest node, or all that its bound meets."""
    dim = routers.shape[1]
    places = queries.sparkSession.sparkContext.broadcast((routers, nodes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, about = places.value
        held = np.array(sorted(about))
        high = _raised(routes, top)[held]
        radius = np.array([about[n][1] for n in held.tolist()])
        count = [about[n][0] for n in held.tolist()]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            far = _apart(np.concatenate((x, np.zeros((len(x), 1))), axis=1), high)
            if first:
                pairs = [(i, int(j), 0) for i, j in enumerate((far - radius).argmin(axis=1))]
            else:
                reach = batch.column(2).to_numpy() + _SLACK * (1 + 2 * np.sqrt(top))
                pairs = [(i, j, p) for i, j in zip(*np.nonzero(far - radius <= reach[:, None]), strict=True)
                         for p in range(count[j])]
            rows = pa.array([i for i, _, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(held[j]) for _, j, _ in pairs], pa.int32()),
                 pa.array([p for _, _, p in pairs], pa.int32()), batch.column(0).take(rows),
                 batch.column(1).take(rows), batch.column(2).take(rows)], names=["node", "part", "id", "vec", "bound"])

    return queries.select("id", "vec", "bound").mapInArrow(
        route, "node int, part int, id long, vec binary, bound double")


def _radii(pages: DataFrame, routers: np.ndarray, top: float) -> dict[int, tuple[int, float]]:
    """Parts and covering radius of each node; one row comes back for each routing object."""
    dim = routers.shape[1]
    routes = pages.sparkSession.sparkContext.broadcast(routers)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = _raised(routes.value, top)
        far, last = np.full(len(high), -1.0), np.zeros(len(high), np.int32)
        for batch in batches:
            if batch.num_rows:
                node, part = (batch.column(i).to_numpy() for i in (0, 1))
                gap = _raised(_matrix(batch.column(2), dim), top) - high[node]
                np.maximum.at(far, node, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
                np.maximum.at(last, node, part)
        seen = np.nonzero(far >= 0)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(last[seen]), pa.array(far[seen])], names=["node", "part", "far"])

    found = pages.select("node", "part", "vec").mapInArrow(reach, "node int, part int, far double").groupBy("node").agg(
        F.max("part").alias("part"), F.max("far").alias("far"))
    return {r.node: (r.part + 1, r.far) for r in found.collect()}


def _one_length(vectors: DataFrame, count: int, top: float, every: int, k: int) -> DataFrame:
    """Top-k among vectors of one length."""
    wanted = int(min(ROUTERS, max(1, count // NODE_ROWS)))
    picked = vectors.orderBy(F.xxhash64("id"), "id", "vec").limit(wanted).select("vec").collect()
    routers = np.unique(np.stack([np.frombuffer(r.vec, "<f8") for r in picked]), axis=0)
    pages = cut(dealt(vectors.select("id", "dim", "vec"), routers, top))
    nodes = _radii(pages, routers, top)
    blocks = max(1, count // every // 1024)
    queries = vectors.where(F.col("id") % every == 0).select("id", "vec", "square").distinct()
    start = _visits(queries.withColumn("bound", F.lit(float("inf"))), nodes, routers, top, first=True)
    seen = (_searched(pages, start, routers, top, k, blocks).groupBy(F.col("query").alias("_q"), F.col("vec").alias("_v"))
            .agg(F.count("*").alias("n"), F.min("score").alias("least")))
    told = queries.join(seen, (F.col("id") == F.col("_q")) & (F.col("vec") == F.col("_v")), "left").withColumn(
        "bound", F.when(F.col("n") >= k, F.sqrt(F.greatest(F.col("square") + top - 2.0 * F.col("least"), F.lit(0.0))))
        .otherwise(F.lit(float("inf"))))
    found = _searched(pages, _visits(told, nodes, routers, top, first=False), routers, top, k, blocks)
    best = Window.partitionBy("query", "vec").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query", "rank", "id", "score")


def top_k(rows: DataFrame, every: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query``, ``rank``, ``id``, ``score``: each query's ``k`` greatest inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``. Rows without an id, without components or with a
    null or non-finite one take no part; identical rows count once; rows that share a query's id are no
    candidates of it, and vectors of another length are none either. Scores are exact while they fit a long.
    """
    vectors = whole_vectors(rows, id_col, vector_col)
    lengths = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("top")).orderBy("dim").collect()
    parts = [_one_length(vectors.where(F.col("dim") == r.dim), r.n, r.top, every, k) for r in lengths]
    if not parts:
        return vectors.select(F.col("id").alias("query"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, parts)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=100).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1),
    lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
