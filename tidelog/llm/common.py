"""What the operators of this package share: durable intermediate tables, byte-bounded batches, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir, written

__all__ = ["shared_dir", "durable", "table", "broadcast_if_small", "let", "byte_chunks", "texts_of"]

#: The most rows of two longs (about 8 MB) that a join may broadcast; beyond it Spark's own join takes over.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors take nothing along."""
    return written(df, label)


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows stay within the bound. df must be durable: it is counted and read again."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def give_back() -> None:
    """Returns memory that was freed to the system: a Python worker outlives its task, and what it keeps is lacking in the next one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda function an expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def byte_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about `most` bytes of text each (one longer text alone may exceed it)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Nulls as empty texts."""
    return [x or "" for x in batch.column(text).to_pylist()]
