"""Value deduplication: content fingerprints, reference counts, garbage, and the offline drain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of at least so many bytes are shared by content; shorter ones are stored with their keys.
THRESHOLD = 64
#: Bytes of a stored record besides its value: fingerprint 20, flag 1, two lengths of 5, checksum 4.
RECORD_BYTES = 35
GC_THRESHOLD = 0.5


def branch(value: Column, threshold: int = THRESHOLD) -> Column:
    return F.when(F.octet_length(value) >= threshold, "large").otherwise("small")


def fingerprint(value: Column) -> Column:
    """SHA-1 as 40 hexadecimal digits."""
    return F.sha1(value.cast("binary"))


def index(values: DataFrame, value: str = "value", seq: str = "seq", threshold: int = THRESHOLD) -> DataFrame:
    """(fp, refcount, first_seq, size) of the shared values; one aggregation over fingerprints, values never leave their scan."""
    big = values.filter(F.octet_length(value) >= threshold)
    big = big.select(fingerprint(F.col(value)).alias("fp"), F.col(seq).alias("seq_"), F.octet_length(value).cast("long").alias("size_"))
    return big.groupBy("fp").agg(F.count("*").alias("refcount"), F.min("seq_").alias("first_seq"), F.max("size_").alias("size"))


def separate(values: DataFrame, value: str = "value", seq: str = "seq", threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(log with fp in place of large values, unique values by fp): key-value separation; dereference() is the inverse."""
    large = F.octet_length(value) >= threshold
    log = values.withColumn("fp", F.when(large, fingerprint(F.col(value)))).withColumn(value, F.when(~large, F.col(value)))
    unique = values.filter(large).select(fingerprint(F.col(value)).alias("fp"), F.col(value).alias("body"), F.col(seq).alias("s_"))
    return log, unique.groupBy("fp").agg(F.min_by("body", "s_").alias("body"))


def dereference(log: DataFrame, unique: DataFrame, value: str = "value") -> DataFrame:
    return log.join(unique, "fp", "left").withColumn(value, F.coalesce(value, "body")).drop("body", "fp")


def stats(values: DataFrame, value: str = "value", threshold: int = THRESHOLD) -> DataFrame:
    """One row: operations, small ones, hits and misses of the content index, bytes in, bytes stored, bytes saved."""
    fp = F.when(F.octet_length(value) >= threshold, fingerprint(F.col(value)))
    size = F.octet_length(value).cast("long")
    by = values.select(fp.alias("fp"), size.alias("size")).groupBy("fp", "size").agg(F.count("*").alias("n"))
    large = F.col("fp").isNotNull()
    out = by.agg(
        F.sum("n").alias("n_ops"),
        F.sum(F.when(~large, F.col("n")).otherwise(0)).alias("n_small"),
        F.sum(F.when(large, F.col("n") - 1).otherwise(0)).alias("hits"),
        F.sum(large.cast("long")).alias("misses"),
        F.sum(F.col("n") * F.col("size")).alias("bytes_in"),
        F.sum(F.when(large, F.col("size") + RECORD_BYTES).otherwise(F.col("n") * F.col("size"))).alias("bytes_stored"),
    )
    return out.withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_stored"))


def refcounts_after(values: DataFrame, live_keys: DataFrame, key: str = "user_key", value: str = "value", seq: str = "seq", threshold: int = THRESHOLD) -> DataFrame:
    """(fp, refcount, live, size, garbage): references in the log, references of rows that survive, and the bytes freed where none does."""
    big = values.filter(F.octet_length(value) >= threshold).select(key, F.col(seq).alias("s_"), fingerprint(F.col(value)).alias("fp"), F.octet_length(value).cast("long").alias("size"))
    alive = big.join(live_keys.select(key, F.col(seq).alias("s_"), F.lit(1).alias("one")), [key, "s_"], "left")
    out = alive.groupBy("fp").agg(F.count("*").alias("refcount"), F.count("one").alias("live"), F.max("size").alias("size"))
    return out.withColumn("garbage", F.when(F.col("live") == 0, F.col("size") + RECORD_BYTES).otherwise(0).cast("long"))


def gc_candidates(refs: DataFrame, file_of: Column, threshold: float = GC_THRESHOLD) -> DataFrame:
    """(file_id, total, garbage, ratio) of the value files whose share of garbage reaches the threshold."""
    files = refs.groupBy(file_of.alias("file_id")).agg(F.sum(F.col("size") + RECORD_BYTES).alias("total"), F.sum("garbage").alias("garbage"))
    return files.withColumn("ratio", F.round(F.col("garbage") / F.col("total"), 6)).filter(F.col("garbage") >= F.lit(threshold) * F.col("total"))


def drain(batch: DataFrame, key: str = "user_key", value: str = "value", seq: str = "seq", threshold: int = THRESHOLD) -> DataFrame:
    """The offline pass over a queued batch: the newest put of each key only (other operations are skipped), then the content index of those."""
    puts = batch.filter(F.col("op") == "PUT")
    newest = puts.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(seq).alias("s")), seq).alias("e"))
    return index(newest.select(F.col("e.v").alias(value), F.col("e.s").alias(seq)), value, seq, threshold)


def use_inline(batch_bytes: Column, capacity: int, share: float = 0.8) -> Column:
    """The elastic mode: inline once a batch fills `share` of its memory, offline before."""
    return batch_bytes / capacity >= share


def apply_changes(changes: DataFrame) -> DataFrame:
    """(fp, refcount, first_location, location) after changes (fp, seq, change, location) to a content index, in order: 'insert' counts one and sets a location where there is none,
    'inc' and 'dec' count, never below 0, 'retarget' sets the location, 'evict' forgets all before it."""
    w = Window.partitionBy("fp")
    rows = changes.withColumn("cut", F.coalesce(F.max(F.when(F.col("change") == "evict", F.col("seq"))).over(w), F.lit(-1))).filter(F.col("seq") > F.col("cut"))
    step = F.when(F.col("change").isin("insert", "inc"), 1).when(F.col("change") == "dec", -1).otherwise(0)
    upto = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.sum(step).over(upto))
    return rows.groupBy("fp").agg(
        (F.max_by("sum_", "seq") - F.least(F.min("sum_"), F.lit(0))).alias("refcount"),
        F.min_by("location", F.when(F.col("change") == "insert", F.col("seq"))).alias("first_location"),
        F.coalesce(F.max_by("location", F.when(F.col("change") == "retarget", F.col("seq"))), F.min_by("location", F.when(F.col("change") == "insert", F.col("seq")))).alias("location"),
    )


def victims(index: DataFrame, k: int) -> DataFrame:
    """The k entries whose stamps are oldest; ties by fingerprint."""
    return index.orderBy("stamp", "fp").limit(k)
