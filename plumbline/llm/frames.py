"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.session import scratch_path

#: Bytes of text that a task holds at once when it works through an Arrow batch.
SLICE_BYTES = 1 << 20


def keyed_text(df: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """``id`` and ``text`` (null stays null) plus named columns; whatever else the input has is left out."""
    return df.select(
        df[id_col].cast("long").alias("id"),
        df[text_col].cast("string").alias("text"),
        *[df[c] for c in others],
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges holding about ``limit`` bytes; a longer row is a slice of its own."""
    rows = batch.num_rows
    if rows == 0:
        return
    if batch.nbytes <= limit or rows == 1:
        yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)


def text_bytes(column: pa.Array):
    """A string column's bytes and row offsets as numpy arrays; a null is empty."""
    import numpy as np

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


_resident: dict[str, Any] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """The one large table that a task process keeps from task to task; a table of another name takes its place."""
    if name not in _resident:
        make_room()
        _resident[name] = make()
    return _resident[name]


def make_room() -> None:
    """Drop what tasks of another kind have left in this process, and give freed memory back to the machine."""
    _resident.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

