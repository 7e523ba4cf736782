"""Small helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """The frame as files in the shared checkpoint folder, so its lineage ends there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, read by column."""
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts go to the workers in batches of about ``size``, unless the session names another bound than Spark's own."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, size)


def utf8(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(columns: list[str], n: int) -> list[str]:
    """``n`` column names that a table does not have."""
    taken = {c.lower() for c in columns}
    free = (f"_own{k}" for k in range(len(taken) + n))
    return [c for c in free if c not in taken][:n]


def pieces(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes together; one row at least."""
    column = batch.column(text)
    start, held = 0, 0
    for i in range(batch.num_rows):
        size = column[i].as_buffer().size if column[i].is_valid else 0
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def sized_pieces(batch: pa.RecordBatch, sizes: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes (a column) add up to ``limit``, about; one row at least."""
    held = batch.column(sizes).fill_null(0).to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = start + max(1, int(np.searchsorted(np.cumsum(held[start:]), limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def released(scan):
    """A task's scan that hands back, at its end, the memory that Arrow and the allocator keep: workers go on with
    other stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8; null as no bytes."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns as one table, from a partition sorted by them.

    Memory holds one run; use it only where something bounds a run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i) for i in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in columns)
        changed[0] = last is not None and first != last
        last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
        at = 0
        for stop in np.nonzero(changed)[0]:
            if stop > at:
                held.append(batch.slice(at, stop - at))
            yield pa.Table.from_batches(held)
            held, at = [], stop
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
