"""Helpers that the training-data operators share: scratch tables, byte-bounded Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logweave.operators.graph import shared_path, shuffles_removed

#: Arrow slices handed to numpy kernels hold about this many bytes of text, whatever the number of rows.
SLICE_BYTES = 4 << 20
#: As many where a kernel takes arrays of numbers by word or by byte, of many times the text's size.
SMALL_SLICE_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return shared_path(spark, name)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    What the write shuffled is removed with it, as nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put(fsys, temp: str, final: str) -> None:
    """Give a whole file its name, in place of what an attempt that was lost may have left under it."""
    try:
        fsys.move(temp, final)
    except OSError:  # some file systems don't move onto a file
        fsys.delete_file(final)
        fsys.move(temp, final)


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 length of each value, nulls 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def release_unused() -> None:
    """Give back to the system what Arrow's and C's allocators hold and nobody uses: a worker outlives its tasks, and so would that."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _TRIM = None


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about `limit` bytes of `column`, and one row at least.

    After each batch memory that is free goes back to the system.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(text_bytes(batch.column(column)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
        del batch
        release_unused()


def filled(column: pa.Array) -> pa.Array:
    """The strings with nulls as the empty string, from offset 0."""
    import pyarrow.compute as pc

    return pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i; empty segments give 0. Takes 8 bytes a value."""
    total, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        total[full] = np.add.reduceat(values[: offsets[-1]], offsets[full], dtype=np.int64)
    return total
