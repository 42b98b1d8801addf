"""Point reads and scans over a resolved state (cf, user_key, value, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(state: DataFrame, key, column: str = "user_key") -> DataFrame:
    return state.filter(F.col(column) == F.lit(key))


def get_entity(state: DataFrame) -> DataFrame:
    """Plain values as entities with one unnamed column."""
    return state.withColumn("columns", F.coalesce("columns", F.create_map(F.lit(""), F.col("value"))))


def default_column(state: DataFrame) -> DataFrame:
    """The value a plain read gives: that of the unnamed column of an entity, empty where it has none."""
    entity = F.coalesce(F.try_element_at("columns", F.lit("")), F.lit(""))
    return state.withColumn("value", F.when(F.col("columns").isNotNull(), entity).otherwise(F.col("value")))


def multi_get(state: DataFrame, keys: DataFrame, key: str = "user_key") -> DataFrame:
    """(pos, key, found, rest of state) for every row of keys (pos, key): repeats stay, in the order asked."""
    return keys.join(state.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def key_may_exist(keys: DataFrame, state: DataFrame, key: str = "user_key") -> DataFrame:
    """The keys that exist; exact, so a key left out is definitely absent."""
    return keys.join(state.select(key), key, "left_semi")


def scan(state: DataFrame, lo=None, hi=None, prefix: str | None = None, reverse: bool = False, limit: int | None = None, key: str = "user_key") -> DataFrame:
    """Rows with lo <= key < hi in key order; bounds and prefix reach the file scan where the state is a plain table."""
    c = F.col(key)
    if lo is not None:
        state = state.filter(c >= F.lit(lo))
    if hi is not None:
        state = state.filter(c < F.lit(hi))
    if prefix is not None:
        state = state.filter(c.startswith(prefix))
    state = state.orderBy(c.desc() if reverse else c.asc())
    return state if limit is None else state.limit(limit)


def seek(state: DataFrame, target, n: int = 1, key: str = "user_key") -> DataFrame:
    """The n rows from the first key at or above the target on."""
    return state.filter(F.col(key) >= F.lit(target)).orderBy(key).limit(n)


def seek_for_prev(state: DataFrame, target, n: int = 1, key: str = "user_key") -> DataFrame:
    """The n rows from the last key at or below the target backwards."""
    return state.filter(F.col(key) <= F.lit(target)).orderBy(F.col(key).desc()).limit(n)


def properties(log: DataFrame, value: Column | None = None) -> DataFrame:
    """Entry counts and sizes of a log by column family."""
    value = F.col("value") if value is None else value
    size = F.octet_length(F.coalesce(value.cast("string"), F.lit("")))
    count = lambda *ops: F.sum(F.col("op").isin(*ops).cast("int")).cast("long")
    return log.groupBy("cf").agg(
        F.count("*").alias("n_entries"),
        F.countDistinct("user_key").alias("n_keys"),
        count("DELETE", "SINGLE_DELETE").alias("n_deletes"),
        count("MERGE").alias("n_merges"),
        count("DELETE_RANGE").alias("n_range_deletes"),
        F.sum(size).cast("long").alias("value_bytes"),
        F.max("seq").alias("last_seq"),
    )


def segment_ranges(rows: DataFrame, file: str, segment: Column) -> DataFrame:
    """(file, n, n_empty, lo, hi): the least and greatest value of a key segment in each file, empty ones told apart."""
    empty = segment.isNull() | (segment.cast("string") == "")
    return rows.groupBy(file).agg(F.count("*").alias("n"), F.sum(empty.cast("long")).alias("n_empty"), F.min(F.when(~empty, segment)).alias("lo"), F.max(F.when(~empty, segment)).alias("hi"))


def may_hold(files: DataFrame, lo, hi) -> DataFrame:
    """The files that may hold a segment in [lo, hi]; the others need not be read."""
    return files.filter((F.col("lo") <= F.lit(hi)) & (F.col("hi") >= F.lit(lo)))


def table_filter(rows: DataFrame, files: DataFrame, keep: Column, file: str) -> DataFrame:
    """rows of the files whose properties pass."""
    return rows.join(files.filter(keep).select(file), file, "left_semi")


def approximate_size(state: DataFrame, ranges: DataFrame, key: str = "user_key") -> DataFrame:
    """(range_id, n, bytes), exact, of each [lo, hi)."""
    from .ranges import multi_scan

    size = F.octet_length(F.col(key).cast("string")) + F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit("")))
    return multi_scan(state, ranges, key).groupBy("range_id").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.99, 0.999)) -> DataFrame:
    """The value at place floor(p * (n - 1)) of each group, from 0, without interpolation; groups are ranked from counts of distinct values, not sorted lists."""
    from pyspark.sql.window import Window

    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    name = lambda p: "p" + str(p * 100).rstrip("0").rstrip(".").replace(".", "")
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[at(p).alias(name(p)) for p in points], (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("avg"))
