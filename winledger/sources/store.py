"""Stored traces by day of start, with an index of their ids, and upserts that rewrite touched days only.

The index is a table of Bloom filters beside the data (``_ids``, which readers pass over): a row holds the ids of one
day and one of ``SEGMENTS`` parts of the ids, ``CHUNK`` ids at most. An upsert tests its ids against the filters, reads
the ids of the days in which any may stand, rewrites those in which one does, and appends to the others, whose files
stay as they are. Filters are
written before the rows they speak of, so a row is never missed when an upsert is cut short; doing it again mends
the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.plans.ordered import held

SEGMENTS = 64
CHUNK = 1 << 16
BITS, PROBES = 12, 6  # bits of a filter for each id, places looked at: about 3 of 1000 ids are found by mistake
KEY = ["tenant_id", "trace_id"]
INDEX = "_ids/by_day"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """(probe, id) bit numbers in a filter of ``size`` bits, a power of two."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return (hashes + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(size - 1)


def bloom(hashes: np.ndarray) -> bytes:
    size = 1 << max(10, int(BITS * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the ids may be in the filter."""
    row = np.frombuffer(bits, np.uint8)
    at = _places(hashes, 8 * len(row))
    return ((row[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _ids(traces: DataFrame) -> DataFrame:
    h = F.xxhash64(*KEY)
    return traces.select("date", F.pmod(F.shiftrightunsigned(h, 8), F.lit(SEGMENTS)).cast("int").alias("seg"), h.alias("h"))


def _packed(ids: DataFrame, made, schema: str) -> DataFrame:
    """What ``made`` does with the hashes of each (date, seg), ``CHUNK`` at a time."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_, size = None, [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.date32()), pa.array([last[1]], pa.int32()),
                 pa.array([made(np.concatenate(held_))], pa.binary())], names=["date", "seg", "bits"])

        for batch in batches:
            date = batch.column(0).cast(pa.int32()).fill_null(0).to_numpy()
            seg, h = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            begin = np.nonzero(np.concatenate(([True], (date[1:] != date[:-1]) | (seg[1:] != seg[:-1]))))[0] if len(seg) else []
            for a, b in zip(begin, [*begin[1:], len(seg)], strict=True):
                key = batch.column(0)[int(a)].as_py(), int(seg[a])
                if size and key != last:
                    yield sent()
                    held_, size = [], 0
                last = key
                for x in range(a, b, CHUNK):
                    part = h[x:min(b, x + CHUNK)]
                    if size and size + len(part) > CHUNK:
                        yield sent()
                        held_, size = [], 0
                    held_.append(part.copy())
                    size += len(part)
        if size:
            yield sent()

    spread = F.pmod(F.shiftrightunsigned("h", 16), F.lit(64))  # a day may be large: its parts are spread further
    return ids.repartition("date", "seg", spread).sortWithinPartitions("date", "seg").mapInArrow(scan, schema)


_INDEX = "date date, seg int, bits binary"


def _index(traces: DataFrame) -> DataFrame:
    return _packed(_ids(traces), bloom, _INDEX)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _dated(traces: DataFrame) -> DataFrame:
    return traces.withColumn("date", F.to_date("ts_start"))


def _write(rows: DataFrame, path: str, *, replace: bool = False) -> None:
    writer = rows.write.mode("overwrite" if replace else "append").partitionBy("date")
    (writer.option("partitionOverwriteMode", "dynamic") if replace else writer).parquet(path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Append traces that are known to be new, by day of start, and their ids."""
    rows = held(_dated(traces))
    _write(_index(rows), f"{path}/{INDEX}")
    _write(rows, path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("date")


def latest(new: DataFrame, seq: str | None = None) -> DataFrame:
    """One row of each id: the largest ``seq``, then the latest end, then by content."""
    shape = [c for c in new.columns if c != seq]
    order = F.struct(*([F.col(seq)] if seq else []), F.col("ts_end"), F.col("ts_start"), F.xxhash64(*shape))
    return new.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(
        F.max_by(F.struct(*shape), order).alias("_t")).select("_t.*")


def touched_days(new: DataFrame, index: DataFrame) -> list:
    """The days whose filters may hold one of the new ids. A list of days is all that comes to the driver."""
    none = F.lit(None).cast("date")
    asked = _packed(_ids(new).withColumn("date", none), lambda h: h.tobytes(), _INDEX).select(
        F.col("seg").alias("_seg"), F.col("bits").alias("_ids"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [may_hold(bits, np.frombuffer(ids, np.uint64)).any()
                   for bits, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.select([0]).filter(pa.array(hit, pa.bool_()))

    found = index.join(asked, F.col("seg") == F.col("_seg")).select("date", "bits", "_ids").mapInArrow(test, "date date")
    return [r["date"] for r in found.distinct().collect()]


def days_holding(new: DataFrame, path: str, days: list) -> list:
    """Those of the ``days`` in which one of the new ids stands. Of many ids some are in a filter by mistake, and a day is
    rewritten whole, so the ids of these days are read first, and nothing else of their rows."""
    if not days:
        return []
    old = new.sparkSession.read.schema(new.schema).parquet(path).where(F.col("date").isin(days)).select("date", *KEY)
    asked = new.select(*[F.col(k).alias(f"_{k}") for k in KEY])
    found = old.join(asked, [F.col(k) == F.col(f"_{k}") for k in KEY], "left_semi")
    return [r["date"] for r in found.select("date").distinct().collect()]


def upsert_traces(new: DataFrame, path: str, *, seq: str | None = None) -> list:
    """Insert or replace by (tenant_id, trace_id) in the stored table; the days that were rewritten.

    Among the new rows the one with the largest ``seq`` wins (see ``latest``). A trace whose day of start changes
    leaves its old day. Days in which no new id stands only get more files; empty input changes nothing."""
    spark = new.sparkSession
    won = held(_dated(latest(new, seq)))
    index = _stored(spark, f"{path}/{INDEX}")
    days = days_holding(won, path, touched_days(won, index)) if index is not None else []
    _write(_index(won), f"{path}/{INDEX}")
    if not days:
        _write(won, path)
        return []
    here = F.col("date").isin(days)
    old = spark.read.schema(won.schema).parquet(path).where(here)
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    kept = old.join(won.select(*[F.col(k).alias(f"_{k}") for k in KEY]), same, "left_anti")
    rewritten = held(kept.unionByName(won.where(here)))
    _write(won.where(~here | F.col("date").isNull()), path)
    _write(rewritten, path, replace=True)
    left = {r["date"] for r in rewritten.select("date").distinct().collect()}
    for day in set(days) - left:  # an overwrite of partitions does not clear one that has no row any more
        for folder in (f"{path}/date={day}", f"{path}/{INDEX}/date={day}"):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _write(_index(rewritten), f"{path}/{INDEX}", replace=True)
    return sorted(left)
