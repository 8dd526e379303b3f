"""Shared helpers: table reading and byte views of Arrow text."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from skein.plans.durable import durable, partitions, release, settle, shared_dir, small_enough

__all__ = ["durable", "one_thread", "partitions", "read", "refuse", "release", "settle", "shared_dir", "small_enough", "split_batches", "text_bytes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def refuse(df: DataFrame, prefix: str) -> None:
    """Columns whose names an operator needs for itself are an error, not a silent clash."""
    bad = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    if bad:
        raise ValueError(f"reserved column names: {bad}")


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its n+1 offsets, without a copy; nulls are empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_null(array.type):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, off, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first : int(offsets[-1])] if len(offsets) else raw[:0], offsets - first


def split_batches(batch, limit_bytes: int = 8 << 20, column: str = "text"):
    """Slices of a record batch of about ``limit_bytes`` of text each; a longer text has a slice of its own."""
    _, off = text_bytes(batch.column(column))
    start, n = 0, len(off) - 1
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def one_thread() -> None:
    """Spark runs a task on each core, so numeric libraries keep to one thread."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")
