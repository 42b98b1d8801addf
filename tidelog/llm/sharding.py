"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: The multiplier of the generator in the published jump consistent hash; a fixed value.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key. Every round moves the keys that still jump; about ln(shards) rounds matter."""
    state = keys.astype(np.uint64).copy()
    at, nxt = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = nxt[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """jump() over the 64-bit hash of any column, cast integers to long first (shard() does); a null key has a hash like any other value."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy("int64").view("uint64"), shards))

    return place(F.xxhash64(key))


def _stable(docs: DataFrame, key: str) -> Column:
    """The key as the type that its hash is taken of, so that a row's shard doesn't depend on the width of its column."""
    return F.col(key).cast("long") if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.col(key)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size is the UTF-8 bytes of the text plus 1, text_crc32 the CRC-32 of these bytes. Slots count from 0 in each shard
    without gaps: rows are dealt into small buckets by hash of their place in the input, buckets are numbered by a prefix sum of their
    counts, and only a bucket is ever sorted, so neither a large shard nor a key that many rows repeat meets one task.
    Null text: size 1, CRC 0. Null keys: one shard, as for any value. Equal rows: slots of their own. Empty table:
    empty result. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(_stable(docs, key), shards).alias("shard"),
        jump_shard(_stable(docs, key), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = durable(rows, "shards")
    buckets = max(1, rows.count() // (bucket_rows * shards))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place"))
    return rows.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + rank - 1).alias("slot"), "grown_shard"
    )
