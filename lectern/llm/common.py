"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* only the columns an operator needs are read; further columns, whatever their
  names, are ignored unless the operator says that it passes them through;
* a null text is an empty text;
* intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
  every executor can read, so a lost executor costs only a re-read.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.sources.scratch import discard, materialise, release, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as it takes not to clash with a column."""
    while name in df.columns:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, starting at 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Split a batch into runs of whole rows with about ``most`` bytes of text each (always one row at least)."""
    _, o = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(batch)
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def give_back() -> None:
    """Return freed memory to the system: allocators keep what they once had, and Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length) run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
