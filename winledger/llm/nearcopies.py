"""Near copies by the Jaccard similarity of their word shingles, for the pipeline.

Texts with the same words in order are one node with a SimHash print of ``BITS`` bits. Each node is filed under the
blocks of bits that several permutations of its print are cut into, and nodes that share a block are compared by their
prints, tile by tile; those within ``MOST`` bits are candidates, sent on as spanning forests. The components of the
candidates are groups; inside a group every pair is decided by the shingles of the whole texts, but for those whose nodes
links have already brought together: first every node against the least of the group, then whoever stands outside the
largest component against everyone there in another one. For that the group is cut into tiles; a task compares two tiles
by the places of their shingles, and sends on one link for each two components that meet, never the pairs.

The prints of texts of similarity 0.8 differ in about 39 of 256 bits. There are blocks enough that even prints as far
apart as ``FAR`` share none with a probability of ``MISSED`` only; blocks get longer with the number of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winledger.llm.graph import components
from winledger.llm.shared import cut, pieces, released, runs, shuffle_parts, small_batches, stored, text_bytes, utf8
from winledger.llm.simhash import best_rows, shingle_hashes, spanning

WORDS = 5
ALIKE = (4, 5)  # a similarity of 4/5 or more
BITS, MOST = 256, 72  # of a print, and how many may differ; prints of other texts differ in 128, give or take 8
FAR, MISSED = 0.196, 0.0005  # share of bits that differ; 0.8 gives 0.152, give or take 0.022
PRINT = [f"p{i}" for i in range(BITS // 64)]
CROWD = 4096  # nodes of a block from which on those close to its least node are not compared with each other
_PIECE = 1 << 20
TILE = 1024  # nodes that one task compares with as many others
TILE_HASHES = 1 << 20  # shingles of a tile, about
_MEETINGS = 1 << 22  # places of equal shingles looked at together
_WIDTH = 5  # bytes of a shingle's hash that are kept where sets are compared
MARKS = 1 << 25  # bits by which texts that are not wanted are passed over
_FILED = 2048  # prints that are cut into blocks at a time
_SHIFTS = np.random.default_rng(42).integers(0, 1 << 63, len(PRINT), np.uint64)


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, size))


def packed(hashes: np.ndarray) -> bytes:
    """The distinct low bytes of some hashes, in order."""
    low = np.unique(hashes & np.uint64((1 << 8 * _WIDTH) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, _WIDTH)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :_WIDTH] = rows
    return out.view("<u8").ravel()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


def meeting(sets: list[np.ndarray], roots: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) places of alike sets that join the components of ``roots`` as all alike pairs of ``xs`` and ``ys`` would."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(ys)), sizes[ys])
    every = np.concatenate([sets[y] for y in ys])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    asked = np.concatenate([sets[x] for x in xs])
    low, high = np.searchsorted(every, asked, "left"), np.searchsorted(every, asked, "right")
    ends = np.cumsum(sizes[xs])
    work = np.concatenate(([0], np.cumsum(high - low)))[ends]
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while top.setdefault(r, r) != r:
            top[r] = r = top[top[r]]
        return r

    links, at = [], 0
    while at < len(xs):
        done = work[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(work, done + _MEETINGS, "right")))
        part = slice(ends[at] - sizes[xs[at]], ends[stop - 1])
        count = (high - low)[part]
        place = np.repeat(low[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        mine = np.repeat(np.repeat(np.arange(stop - at), sizes[xs[at:stop]]), count)
        both = np.bincount(mine * len(ys) + owner[place], minlength=(stop - at) * len(ys)).reshape(stop - at, len(ys))
        all_ = sizes[xs[at:stop], None] + sizes[None, ys] - both
        i, j = np.nonzero((ALIKE[1] * both >= ALIKE[0] * all_) & (roots[xs[at:stop], None] != roots[None, ys]))
        i, j = xs[at + i], ys[j]
        _, first = np.unique(np.stack((roots[i], roots[j])), axis=1, return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
            a, b = find(int(roots[x])), find(int(roots[y]))
            if a != b:
                top[a] = b
                links.append((x, y))
        at = stop
    return links


def long_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: the bits that over half of them set, as ``len(PRINT)`` words."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16 * 255):
        x = hashes[at:at + 16 * 255, None] + _SHIFTS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # as many ones as a byte counts
            counts += bits[low:low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def blocks(n: int) -> np.ndarray:
    """The places of the bits of each block among ``n`` prints: blocks that permutations of the places are cut into."""
    width = max(4, round(math.log2(max(n, 1)) / 2))
    wanted = math.ceil(math.log(MISSED) / math.log1p(-(1 - FAR) ** width))
    rng, found = np.random.default_rng(42), []
    while len(found) < wanted:
        order = rng.permutation(BITS)
        found += [order[i:i + width] for i in range(0, BITS - width + 1, width)]
    return np.array(found[:wanted])


def block_keys(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The blocks of each print (rows of words) as longs; each says its place."""
    bits = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    keys = np.zeros((len(prints), len(places)), np.int64)
    for i in range(places.shape[1]):
        keys += bits[:, places[:, i]].astype(np.int64) << i
    return keys + (np.arange(len(places), dtype=np.int64) << 32)


def close_forest(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the nodes ``a`` with prints ``x`` and ``b`` with ``y`` as all pairs within ``MOST`` bits would."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = place[:len(a)], place[len(a):]
    left, right = [], []
    for at in range(0, len(a), 256):
        part = x[at:at + 256]
        differ = sum(np.bitwise_count(part[:, None, i] ^ y[None, :, i]) for i in range(len(PRINT) - 1))
        near = differ <= MOST
        differ += np.bitwise_count(part[:, None, -1] ^ y[None, :, -1])
        i, j = np.nonzero(near & (differ <= MOST))
        i, j = ia[at + i], ib[j]
        left.append(i[i != j])
        right.append(j[i != j])
    return spanning(nodes, np.concatenate(left), np.concatenate(right))


def _node(text: bytes) -> int:
    words = text.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else 0


def signed(rows: DataFrame) -> DataFrame:
    """``_id``, ``_hash``, ``node``, ``n`` (distinct shingles) and the words of the print of ``_id``, ``_hash``, ``_text``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                node, n, prints = [], [], []
                for text in text_bytes(part.column(2)):
                    hashes = shingle_set(text)
                    node.append(_node(text))
                    n.append(len(hashes))
                    prints.append(long_print(hashes))
                words = np.array(prints).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int32()),
                     *(pa.array(words[:, i]) for i in range(len(PRINT)))], names=["_id", "_hash", "node", "n", *PRINT])

    small_batches(rows.sparkSession)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_hash", "_text").mapInArrow(
        released(scan), f"_id {kind}, _hash long, node long, n int, " + ", ".join(f"{p} long" for p in PRINT))


def _filed(nodes: DataFrame, places: np.ndarray) -> DataFrame:
    """``main``, ``node`` and the print for every node under each of its blocks."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FILED):
                part = batch.slice(at, _FILED)
                keys = block_keys(np.stack([part.column(i).to_numpy() for i in range(1, 1 + len(PRINT))], axis=1)
                                  .view(np.uint64), places)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * len(places)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                                                 names=["node", *PRINT, "keys"])

    return nodes.select("node", *PRINT).mapInArrow(
        scan, "node long, " + ", ".join(f"{p} long" for p in PRINT) + ", keys array<long>").select(
        F.explode("keys").alias("main"), "node", *PRINT)


def candidates(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: links whose components are those of all ``node`` s that share a block and are close by their prints.

    The prints are shuffled once, by block; only the few blocks of over ``CROWD`` nodes are counted and cut into tiles for
    several tasks."""
    filed = _filed(nodes, blocks(nodes.count()))
    large = stored(filed.groupBy(F.col("main").alias("_m")).agg(F.count("*").alias("_n"), F.min("node").alias("_first"))
                   .where(F.col("_n") > CROWD))
    if large.isEmpty():
        return _close_blocks(filed)
    plain = filed.join(large, F.col("main") == F.col("_m"), "left_anti")
    size = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    firsts = large.join(nodes, F.col("_first") == F.col("node")).select("_m", "_first", *(F.col(p).alias(f"_{p}") for p in PRINT))
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"_{p}"))) for p in PRINT), F.lit(0))
    crowds = stored(filed.join(firsts, F.col("main") == F.col("_m")).select(
        "main", "node", *PRINT, "_first", (differ <= MOST).alias("inner")))
    sizes = crowds.groupBy(F.col("main").alias("_m")).agg(
        F.sum(F.col("inner").cast("long")).alias("_in"), F.sum((~F.col("inner")).cast("long")).alias("_out"))
    tiled = crowds.join(sizes, F.col("main") == F.col("_m")).select(
        "main", "node", *PRINT, "inner", size("_in").alias("inner_tiles"), size("_out").alias("outer_tiles"))
    stars = crowds.where("inner AND node != _first").select(F.col("node").alias("a"), F.col("_first").alias("b")).distinct()
    return _close_blocks(plain).unionByName(_close(tiled)).unionByName(stars)


def _close_blocks(filed: DataFrame) -> DataFrame:
    """``a``, ``b``: links with the components of all close pairs of each block of ``CROWD`` nodes at most, tile by tile."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 1):
            if run.num_rows < 2:
                continue
            nodes = run.column(1).to_numpy()
            prints = np.stack([run.column(2 + i).to_numpy() for i in range(len(PRINT))], axis=1).view(np.uint64)
            tiles = [slice(at, at + TILE) for at in range(0, len(nodes), TILE)]
            for i, one in enumerate(tiles):
                for two in tiles[i:]:
                    a, b = close_forest(nodes[one], prints[one], nodes[two], prints[two])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (filed.repartition(shuffle_parts(filed.sparkSession), "main").sortWithinPartitions("main")
            .mapInArrow(released(compare), "a long, b long").distinct())


def _close(rows: DataFrame) -> DataFrame:
    """``a``, ``b``: links with the components of all close pairs of a block that hold a node that is not ``inner``."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 4):
            side, nodes = run.column(4).to_numpy(), run.column(5).to_numpy()
            prints = np.stack([run.column(6 + i).to_numpy() for i in range(len(PRINT))], axis=1).view(np.uint64)
            one, two = side == 0, side == 1
            if run.column(1)[0].as_py() and run.column(2)[0].as_py() == run.column(3)[0].as_py():
                two = one
            if one.any() and two.any():
                a, b = close_forest(nodes[one], prints[one], nodes[two], prints[two])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _met(rows, "node", *PRINT).mapInArrow(released(compare), "a long, b long").distinct()


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` of the nodes in ``wanted`` (``_hash`` of one of a node's texts, ``node``)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([packed(shingle_set(t)) for t in text_bytes(part.column(1))],
                                              pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.xxhash64(utf8(text_col)).alias("_h"), utf8(text_col).alias("_text"))
    return (_marked(texts, wanted).join(wanted, F.col("_h") == F.col("_hash")).groupBy("node")
            .agg(F.first("_text").alias("_text")).mapInArrow(released(scan), "node long, shingles binary"))


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``_h`` falls on a mark of the ``_hash`` es in ``wanted``, and few others, so that the
    join that follows does not shuffle every text. The marks are a bitmap of ``MARKS`` bits at most, which is broadcast."""
    size = min(MARKS, 1 << (16 * wanted.count()).bit_length())
    place = lambda c: F.pmod(F.col(c), F.lit(size)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(place("_hash")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("_hash"))).alias("_bits"))
    held = texts.withColumn("_bit", F.bitmap_bit_position(place("_h")))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("long")
    return (held.join(F.broadcast(marks), F.bitmap_bucket_number(place("_h")) == F.col("_bucket"))
            .where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*texts.columns))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingles are alike."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(unpacked(x.as_buffer()), unpacked(y.as_buffer()))
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("_a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("node").alias("_b"), F.col("shingles").alias("_sb"))
    return (pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
            .select("a", "b", "_sa", "_sb").mapInArrow(released(check), "a long, b long"))


def _sized(na: str, nb: str):
    """Sizes that a similarity of ``ALIKE`` allows."""
    return F.least(na, nb) * ALIKE[1] >= F.greatest(na, nb) * ALIKE[0]


def links(docs: DataFrame, text_col: str, rows: DataFrame) -> DataFrame:
    """``a``, ``b``: links among the nodes of ``rows`` (see ``signed``) with the components of all alike candidates."""
    nodes = stored(rows.where("n > 0").groupBy("node").agg(
        F.min("_hash").alias("_hash"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in PRINT)))
    near = components(candidates(nodes), "a", "b").select(F.col("node").alias("_node"), F.col("root").alias("group"))
    met = stored(near.join(nodes, F.col("node") == F.col("_node")).select("group", "node", "n", "_hash"))
    sets = stored(_sets(docs, text_col, met.select("node", "_hash")))
    first = met.where("node = group").select(F.col("group").alias("_group"), F.col("n").alias("first_n"))
    stars = cut(_verified(met.join(first, F.col("group") == F.col("_group")).where("node != group")
                          .where(_sized("n", "first_n")).select(F.col("node").alias("a"), F.col("group").alias("b")), sets))
    roots = components(stars, "a", "b").withColumnRenamed("node", "_node")
    placed = stored(met.join(roots, F.col("node") == F.col("_node"), "left").select(
        "group", "node", "n", F.coalesce("root", "node").alias("root")))
    main = (placed.groupBy("group", "root").agg(F.count("*").alias("_n")).groupBy(F.col("group").alias("_group"))
            .agg(F.max_by("root", F.struct("_n", "root")).alias("_main"), F.count("*").alias("_roots"))
            .where("_roots > 1").drop("_roots"))
    open_ = placed.join(main, F.col("group") == F.col("_group")).select(
        F.col("_main").alias("main"), "node", "n", "root", (F.col("root") == F.col("_main")).alias("inner"))
    return stars.unionByName(_across(stored(open_), sets))


def _met(rows: DataFrame, *carried: str) -> DataFrame:
    """``main``, ``among``, ``t1``, ``t2``, ``side`` and ``carried``: the rows of each ``main`` in every two tiles that meet,
    those not ``inner`` with each other (``among``) and with the inner ones, in a task together and in order."""
    upto = lambda n: F.slice(F.sequence(F.lit(0), F.col(n)), F.lit(1), F.col(n))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("inner_tiles")).otherwise(F.col("outer_tiles"))).cast("int")
    place = lambda among, t1, t2, side: F.struct(
        F.lit(among).alias("among"), t1.alias("t1"), t2.alias("t2"), side.alias("side"))
    with_inner = F.transform(upto("inner_tiles"), lambda j: place(False, F.col("_t"), j, F.lit(0)))
    with_outer = F.transform(upto("outer_tiles"), lambda j: place(
        True, F.least("_t", j), F.greatest("_t", j), (F.col("_t") > j).cast("int")))
    asked = F.transform(upto("outer_tiles"), lambda j: place(False, j, F.col("_t"), F.lit(1)))
    met = rows.withColumn("_t", mine).select(
        "main", F.explode(F.when(F.col("inner"), asked).otherwise(F.concat(with_inner, with_outer))).alias("_p"),
        *carried).select("main", "_p.among", "_p.t1", "_p.t2", "_p.side", *carried)
    return met.repartition(shuffle_parts(rows.sparkSession), "main", "among", "t1", "t2").sortWithinPartitions(
        "main", "among", "t1", "t2")


def _across(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``: links between the nodes outside (not ``inner``) of each ``main`` component and all others of its
    group that have another ``root``, with the components of all alike pairs among them."""
    count = lambda inner, c: F.sum(F.when(F.col("inner") == inner, F.col(c)).otherwise(0))
    tiles = lambda inner: F.greatest(F.lit(1), F.ceil(F.greatest(
        count(inner, "_1") / TILE, count(inner, "n") / TILE_HASHES))).cast("int")
    sizes = groups.withColumn("_1", F.lit(1)).groupBy(F.col("main").alias("_m")).agg(
        tiles(False).alias("outer_tiles"), tiles(True).alias("inner_tiles"))
    rows = groups.join(sizes, F.col("main") == F.col("_m")).join(
        sets.select(F.col("node").alias("_s"), "shingles"), F.col("node") == F.col("_s"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 4):
            among, t1, t2 = (run.column(c)[0].as_py() for c in (1, 2, 3))
            side, nodes, roots = (run.column(c).to_numpy() for c in (4, 5, 6))
            sets_ = [unpacked(x.as_buffer()) for x in run.column(7)]
            xs, ys = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            if among and t1 == t2:
                ys = xs
            if len(xs) and len(ys):
                found = meeting(sets_, roots, xs, ys)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[[x for x, _ in found]], pa.int64()),
                                                  pa.array(nodes[[y for _, y in found]], pa.int64())], names=["a", "b"])

    return _met(rows, "node", "root", "shingles").mapInArrow(released(compare), "a long, b long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of near copies: the least id, then the least hash of the text.

    Texts without words are alike. Of rows alike in id and text one stays; rows with a null id stay only where
    their component has no other. An empty table gives no row.
    """
    rows = stored(signed(docs.select(F.col(id_col).alias("_id"), F.xxhash64(utf8(text_col)).alias("_hash"),
                                     utf8(text_col).alias("_text"))))
    roots = components(links(docs, text_col, rows), "a", "b").withColumnRenamed("node", "_node")
    placed = rows.select("_id", "_hash", "node").join(roots, F.col("node") == F.col("_node"), "left").select(
        "_id", "_hash", F.coalesce("root", "node").alias("root"))
    return best_rows(docs, placed, id_col, text_col)
