"""Near copies by SimHash: fingerprints, pigeonhole blocks, Hamming check, components.

Two 64-bit fingerprints that differ in at most three bits agree on one of four 16-bit blocks, and outside
that block on one of four 12-bit parts of the other 48 bits. Every distinct fingerprint is therefore filed
under 16 keys of 28 bits, and close pairs meet under at least one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winledger.llm.graph import components
from winledger.llm.shared import cut, pieces, runs, shuffle_parts, table, text_bytes, unused, utf8

MAX_BITS = 3
BLOCKS = 4
TILE = 2048  # fingerprints of one key that one task compares with as many others
SEED = 42
_PIECE = 4 << 20


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, or of the whole sequence where there are fewer."""
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: the bits set in over half its values; zero for none."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.nonzero(sizes)[0]
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    at = 0
    while at < len(full):
        stop, held = at, 0
        while stop < len(full) and (stop == at or held + sizes[full[stop]] <= 1 << 16):
            held += sizes[full[stop]]
            stop += 1
        some = full[at:stop]
        every = np.concatenate([hashes[i] for i in some])
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        bits = np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = ((2 * counts > sizes[some, None]) * weights).sum(axis=1, dtype=np.uint64)
        at = stop
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id_col`` and ``fingerprint`` (64 bits as a long) of every row's whole text.

    Null texts and texts without words get fingerprint 0. One row out for each row in, whatever the ids.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, _PIECE):
                prints = majority_bits([shingle_hashes(t, size) for t in text_bytes(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))],
                                                 names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(
        scan, f"`{id_col}` {kind}, fingerprint long")


def block_keys(print_col: str):
    """The 16 keys of a fingerprint: which block, which part of the rest, and their bits, in one long."""
    width = 64 // BLOCKS
    keys = []
    for i in range(BLOCKS):
        block = F.shiftrightunsigned(print_col, i * width).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col(print_col).bitwiseAND(F.lit((1 << (i * width)) - 1)) if i else F.lit(0).cast("long")
        high = (F.shiftleft(F.shiftrightunsigned(print_col, (i + 1) * width), i * width)
                if i < BLOCKS - 1 else F.lit(0).cast("long"))
        rest = low.bitwiseOR(high)
        for j in range(BLOCKS):
            part = F.shiftrightunsigned(rest, j * 12).bitwiseAND(F.lit((1 << 12) - 1))
            keys.append(F.lit((i * BLOCKS + j) << 32).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the close pairs between two sets into the same components as all pairs would."""
    if not len(a) or not len(b):
        return a[:0], a[:0]
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = place[:len(a)], place[len(a):]
    left, right = [], []
    for at in range(0, len(a), 256):
        close = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= most
        x, y = np.nonzero(close)
        x, y = ia[at + x], ib[y]
        keep = x != y
        left.append(x[keep])
        right.append(y[keep])
    return spanning(nodes, np.concatenate(left), np.concatenate(right))


def spanning(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join ``nodes`` into the same components as the pairs of places ``x`` and ``y`` do."""
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        differ = label[x] != label[y]
        if not differ.any():
            break
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def close_links(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``a``, ``b``: links among distinct fingerprints whose components are those of all pairs within ``most`` bits.

    Rows that share a key are cut into tiles; each pair of tiles is compared by one task, which sends on a
    spanning forest and never the pairs themselves.
    """
    if most > MAX_BITS:
        raise ValueError(f"the keys find pairs up to {MAX_BITS} bits apart")
    parts = shuffle_parts(prints.sparkSession)
    filed = prints.select("fingerprint", F.explode(block_keys("fingerprint")).alias("key"))
    crowded = (filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
               .withColumnRenamed("key", "_key"))
    met = (filed.join(crowded, F.col("key") == F.col("_key"))
           .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
           .withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
           .select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
                   (F.col("tile") > F.col("other")).cast("int").alias("side"), "fingerprint"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for run in runs(batches, 3):
            t1, t2 = run.column(1)[0].as_py(), run.column(2)[0].as_py()
            side = run.column(3).to_numpy()
            values = run.column(4).to_numpy().view(np.uint64)
            if len(values) == 2 and t1 == t2:
                if int(values[0] ^ values[1]).bit_count() <= most:
                    found.append((values[1:], values[:1]))
            else:
                first = values[side == 0]
                found.append(_forest(first, first if t1 == t2 else values[side == 1], most))
            if len(found) > 2000:
                yield links(found)
                found = []
        if found:
            yield links(found)

    def links(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return (met.repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
            .mapInArrow(compare, "a long, b long").distinct())


def _placed(prints: DataFrame, id_col: str, most: int) -> DataFrame:
    """``_print`` and ``component_id`` for every distinct fingerprint."""
    nodes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"))
    roots = components(close_links(nodes.select("fingerprint"), most), "a", "b")
    placed = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return placed.join(named, "root").select(F.col("fingerprint").alias("_print"), "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                most: int = MAX_BITS) -> DataFrame:
    """Every row's id, ``fingerprint`` (long) and ``component_id``, the least id its links lead to.

    Fingerprints are made distinct first, so copies cost one row each. Empty and null texts have fingerprint
    0 and are linked like any other. Repeated ids give a row each; rows with a null id keep their place in a
    component but never name it (null only where all its ids are null).
    """
    prints = cut(fingerprints(docs, id_col, text_col, size))
    return prints.join(_placed(prints, id_col, most), F.col("fingerprint") == F.col("_print"), "left").select(
        id_col, "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                    most: int = MAX_BITS) -> DataFrame:
    """One row of every component with its columns: the least id, then the least hash of the text.

    Of rows alike in both, one stays; rows with a null id stay only where their component has no other.
    """
    id_kind = docs.schema[id_col].dataType
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("text")).alias("_key"),
                        utf8(text_col).alias("_text"))
    prints = cut(fingerprints(keyed, "_key", "_text", size).select(
        F.col("_key.id").cast(id_kind).alias("_id"), F.col("_key.text").alias("_hash"), "fingerprint"))
    return best_rows(docs, prints.join(_placed(prints, "_id", most), F.col("fingerprint") == F.col("_print")),
                     id_col, text_col)


def best_rows(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The best row of every ``root`` of ``placed`` (``_id``, ``_hash`` of the text, ``root``) with its columns."""
    rank = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_hash"))
    chosen = (placed.groupBy("root").agg(F.min(rank).alias("_best"))
              .select(F.col("_best._id").alias("_k1"), F.col("_best._hash").alias("_k2")))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    n1, n2, nth = unused(docs.columns, 3)
    held = docs.withColumns({n1: name(id_col), n2: F.xxhash64(utf8(text_col))})
    c1, c2 = unused(held.columns, 2)
    kept = held.join(chosen.select(name("_k1").alias(c1), F.col("_k2").alias(c2)),
                     (F.col(n1) == F.col(c1)) & (F.col(n2) == F.col(c2)), "left_semi")
    alike = Window.partitionBy(n1, n2).orderBy(n1)
    return kept.withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1).select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                         "component_id")
