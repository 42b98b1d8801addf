"""Reports over a trace of operations: (ts in microseconds, type, cf_id, key, value_size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import TRACE_TYPES

READS = (TRACE_TYPES["get"], TRACE_TYPES["multi_get"])
_G = ("type", "cf_id")


def found(trace_type: Column, value_size: Column) -> Column:
    """Reads succeed iff they returned bytes; everything else always does."""
    return F.when(trace_type.isin(*READS), value_size > 0).otherwise(F.lit(True))


def second(ts: Column, start: Column) -> Column:
    return F.floor((ts - start) / 1_000_000).cast("long")


def with_second(trace: DataFrame) -> DataFrame:
    """Adds sec, counted from the first record; the start is one aggregated row, broadcast."""
    return trace.join(F.broadcast(trace.agg(F.min("ts").alias("start_")))).withColumn("sec", second(F.col("ts"), F.col("start_"))).drop("start_")


def totals(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*_G).agg(F.count("*").alias("n_ops"), F.countDistinct("key").alias("n_keys"), F.sum(found(F.col("type"), F.col("value_size")).cast("long")).alias("n_found"))


def key_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*_G, "key").agg(F.count("*").alias("n"), F.max_by("value_size", F.struct("ts", "value_size")).alias("value_size"))


def access_distribution(trace: DataFrame) -> DataFrame:
    return key_counts(trace).groupBy(*_G, F.col("n").alias("accesses")).agg(F.count("*").alias("n_keys"))


def key_size_stats(trace: DataFrame, size: Column | None = None) -> DataFrame:
    """Sizes of the distinct keys: count, mean, population variance and the true (lower) median."""
    size = F.length(F.col("key").cast("string")) if size is None else size
    counts = trace.select(*_G, "key", size.alias("size")).distinct().groupBy(*_G, "size").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*_G).orderBy("size"))
    n = F.sum("c").over(Window.partitionBy(*_G))
    ranked = counts.withColumn("upto", upto).withColumn("n", n)
    s, q = F.sum(F.col("size") * F.col("c")), F.sum(F.col("size") * F.col("size") * F.col("c"))
    total = F.sum("c")
    return ranked.groupBy(*_G).agg(
        total.alias("n_keys"),
        F.round(s / total, 6).alias("mean_size"),
        F.round(q / total - (s / total) * (s / total), 6).alias("var_size"),
        F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("size"))).alias("median_size"),
    )


def value_distribution(trace: DataFrame, interval: int = 8) -> DataFrame:
    begin = (F.floor(F.col("value_size") / interval) * interval).cast("long")
    return trace.groupBy(*_G, begin.alias("size_from")).agg(F.count("*").alias("n"))


def qps(trace: DataFrame) -> DataFrame:
    return with_second(trace).groupBy(*_G, "sec").agg(F.count("*").alias("qps"))


def qps_filled(trace: DataFrame) -> DataFrame:
    """qps() with a zero for every second of each group's span without operations."""
    per = qps(trace)
    span = per.groupBy(*_G).agg(F.min("sec").alias("a"), F.max("sec").alias("z"))
    every = span.select(*_G, F.explode(F.sequence("a", "z")).alias("sec"))
    return every.join(per, [*_G, "sec"], "left").withColumn("qps", F.coalesce("qps", F.lit(0).cast("long")))


def qps_summary(trace: DataFrame) -> DataFrame:
    per = qps(trace)
    return per.groupBy(*_G).agg(F.max("qps").alias("peak"), F.round(F.sum("qps") / (F.max("sec") - F.min("sec") + 1), 6).alias("average"))


def top_seconds(trace: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*_G).orderBy(F.col("qps").desc(), "sec")
    return qps(trace).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_second_prefixes(trace: DataFrame, k: int, prefix: Column) -> DataFrame:
    """Operations by prefix within each group's k busiest seconds."""
    best = top_seconds(trace, k).select(*_G, "sec")
    rows = with_second(trace).join(F.broadcast(best), [*_G, "sec"])
    return rows.groupBy(*_G, "sec", prefix.alias("prefix")).agg(F.count("*").alias("n"))


def top_keys(trace: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*_G).orderBy(F.col("n").desc(), "key")
    return key_counts(trace).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*_G, "key", "n", "rank")


def prefix_cut(trace: DataFrame, prefix: Column) -> DataFrame:
    ok = F.sum(found(F.col("type"), F.col("value_size")).cast("long"))
    out = trace.groupBy(*_G, prefix.alias("prefix")).agg(F.count("*").alias("n_ops"), F.countDistinct("key").alias("n_keys"), ok.alias("n_found"))
    return out.withColumn("avg_accesses", F.round(F.col("n_ops") / F.col("n_keys"), 6)).withColumn("success", F.round(F.col("n_found") / F.col("n_ops"), 6))


def correlation(trace: DataFrame, first: int, then: int) -> DataFrame:
    """(n, mean_gap): operations of type `then` on a key after one of type `first` on it, and the mean time since the last such one."""
    w = Window.partitionBy("cf_id", "key").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type") == first, F.col("ts")), ignorenulls=True).over(w)
    pairs = trace.withColumn("last_", last).filter((F.col("type") == then) & F.col("last_").isNotNull())
    return pairs.groupBy("cf_id").agg(F.lit(first).alias("first_type"), F.lit(then).alias("then_type"), F.count("*").alias("n"), F.round(F.avg(F.col("ts") - F.col("last_")), 3).alias("mean_gap"))


def correlations(trace: DataFrame) -> DataFrame:
    """The same for every pair of types in one pass: the last time of each type so far, by key."""
    w = Window.partitionBy("cf_id", "key").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    types = sorted(TRACE_TYPES.values())
    rows = trace
    for t in types:
        rows = rows.withColumn(f"last_{t}", F.last(F.when(F.col("type") == t, F.col("ts")), ignorenulls=True).over(w))
    pairs = rows.select("cf_id", F.col("type").alias("then_type"), "ts", F.explode(F.array(*[F.struct(F.lit(t).alias("first_type"), F.col(f"last_{t}").alias("at")) for t in types])).alias("p"))
    pairs = pairs.filter("p.at is not null")
    return pairs.groupBy("cf_id", F.col("p.first_type").alias("first_type"), "then_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ts") - F.col("p.at")), 3).alias("mean_gap"))


def whole_key_space(trace: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n) for every key of a key space, accessed or not."""
    counts = trace.groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def unique_growth(trace: DataFrame) -> DataFrame:
    """(cf_id, sec, new_keys, total_keys): keys seen for the first time in each second and so far."""
    firsts = with_second(trace).groupBy("cf_id", "key").agg(F.min("sec").alias("sec"))
    per = firsts.groupBy("cf_id", "sec").agg(F.count("*").alias("new_keys"))
    return per.withColumn("total_keys", F.sum("new_keys").over(Window.partitionBy("cf_id").orderBy("sec")))


def multi_get_counts(trace: DataFrame) -> DataFrame:
    """A batched read counts once for each of its keys (keys array)."""
    return trace.filter(F.col("type") == TRACE_TYPES["multi_get"]).select("cf_id", F.explode("keys").alias("key")).groupBy("cf_id", "key").agg(F.count("*").alias("n"))


def time_series(trace: DataFrame) -> DataFrame:
    return with_second(trace).select("type", "sec", "key")


def sampled(trace: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    return trace.sample(fraction=ratio, seed=seed)


def replay(trace: DataFrame, store, fill: str = "x") -> int:
    """Writes a trace's puts, merges and deletes to a store in the order of their times, with values of the traced sizes; reads change nothing."""
    names = {TRACE_TYPES["put"]: "PUT", TRACE_TYPES["put_entity"]: "PUT", TRACE_TYPES["merge"]: "MERGE", TRACE_TYPES["delete"]: "DELETE", TRACE_TYPES["single_delete"]: "SINGLE_DELETE"}
    op = F.lit(None).cast("string")
    for t, name in names.items():
        op = F.when(F.col("type") == t, name).otherwise(op)
    value = F.when(F.col("op").isin("PUT", "MERGE"), F.repeat(F.lit(fill), F.col("value_size").cast("int")))
    rows = trace.withColumn("op", op).filter("op is not null").select("ts", "op", F.col("cf_id").cast("string").alias("cf"), F.col("key").cast("string").alias("user_key"), value.alias("value"))
    return store.bulk(rows, "ts")
