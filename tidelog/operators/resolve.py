"""The state of a versioned key space at a snapshot, from its operation log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE_RANGE, DELETES, ENTITY, MERGE
from . import merge as merges
from . import ranges


def visible(log: DataFrame, snapshot: int | None = None, read_ts: int | None = None, from_ts: int | None = None, cfs: Sequence[str] | None = None, key_pred: Column | None = None) -> DataFrame:
    """Entries a reader at the snapshot sees; one without a timestamp is in all times. Predicates on cf, key, seq and time stand here, next to the scan, because they can't pass a resolve."""
    if snapshot is not None:
        log = log.filter(F.col("seq") <= snapshot)
    if read_ts is not None:
        log = log.filter(F.col("udt").isNull() | (F.col("udt") <= read_ts))
    if from_ts is not None:
        log = log.filter(F.col("udt").isNull() | (F.col("udt") >= from_ts))
    if cfs is not None:
        log = log.filter(F.col("cf").isin(*cfs))
    if key_pred is not None:
        log = log.filter((F.col("op") == DELETE_RANGE) | key_pred)
    return log


def resolve(
    log: DataFrame,
    snapshot: int | None = None,
    read_ts: int | None = None,
    cfs: Sequence[str] | None = None,
    key_pred: Column | None = None,
    merge: str | merges.Merge | None = None,
    has_merges: bool | None = None,
    has_ranges: bool | None = None,
    ignore_range_deletes: bool = False,
) -> DataFrame:
    """(cf, user_key, value, seq[, columns, udt]): the newest visible version of each key, deletes applied, merge operands folded.

    Without merges it is one aggregation that combines before its shuffle, so a key with very many versions is no burden: a hash aggregate where
    values are numbers, a sort of each partition where they are strings, whose aggregate buffers can't change in place. With merges
    the newest base of each key is aggregated the same way and joined back (adaptive execution splits a hot key there) to leave only newer operands;
    the fold is the operator's own aggregate. Range tombstones hide entries with strictly lower sequence numbers. has_merges / has_ranges spare a look
    at the log where the caller knows.
    """
    v = visible(log, snapshot, read_ts, None, cfs, key_pred)
    if "cf" not in v.columns:
        v = v.withColumn("cf", F.lit("default"))
    if has_ranges is None:
        has_ranges = "end_key" in v.columns and bool(v.filter(F.col("op") == DELETE_RANGE).head(1))
    points = v.filter(F.col("op") != DELETE_RANGE)
    if has_ranges and not ignore_range_deletes:
        points = ranges.drop_covered(points, v.filter(F.col("op") == DELETE_RANGE))
    if has_merges is None:
        has_merges = bool(points.filter(F.col("op") == MERGE).head(1))
    extra = [c for c in ("columns", "udt") if c in v.columns]
    keys = ["cf", "user_key"]
    if not has_merges:
        newest = _newest(points, keys, ["value", *extra])
        return newest.filter(~F.col("gone")).select(*keys, "value", "seq", *extra)
    out = folded(points, keys, merges.named(merge), extra)
    return out.filter((F.col("n_operands") > 0) | ~F.col("base_op").isin(*DELETES)).select(*keys, "value", "seq", *extra)


def _newest(points: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys.., seq, gone, columns..) of the newest entry of each key."""
    kinds = dict(points.dtypes)
    gone = F.col("op").isin(*DELETES)
    if all(kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp") for c in columns):
        # One max_by for each: their buffers are fixed-width, so it is a hash aggregate.
        each = [F.max_by(F.col(c), "seq").alias(c) for c in columns]
        return points.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by(gone, "seq").alias("gone"), *each)
    newest = points.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by(F.struct(gone.alias("gone"), *columns), "seq").alias("e"))
    return newest.select(*keys, "seq", "e.*")


def folded(points: DataFrame, keys: Sequence[str], merge: merges.Merge, extra: Sequence[str] = ()) -> DataFrame:
    """(keys.., value, seq, extra.., base_op, n_operands): each key's newest base, a delete too, with the operands above it folded in.

    base_op is null where a key has operands only. Operands over an entity fold into its unnamed column and leave its others; operands over a
    delete have no base."""
    is_base = F.col("op") != MERGE
    kind = dict(points.dtypes)["value"]
    base = points.filter(is_base).groupBy(*keys).agg(F.max("seq").alias("base_seq"), F.max_by(F.struct("op", "value", *extra), "seq").alias("base"))
    alive = ~F.coalesce(F.col("base.op").isin(*DELETES), F.lit(True))
    live = F.when(alive, F.col("base.value"))
    if "columns" in extra:
        live = F.when(F.col("base.op") == ENTITY, F.try_element_at(F.col("base.columns"), F.lit("")).cast(kind)).otherwise(live)
    about = [live.alias("base_value"), F.col("base.op").alias("base_op"), *[F.when(alive, F.col(f"base.{c}")).alias(c) for c in extra]]
    later = points.filter(~is_base).select(*keys, "seq", "value").join(base, keys, "left").filter(F.col("seq") > F.coalesce("base_seq", F.lit(-1)))
    operands = later.select(*keys, "seq", "value", F.lit(1).alias("one"), *about)
    kept = base.select(*keys, F.col("base_seq").alias("seq"), F.lit(None).cast(kind).alias("value"), F.lit(0).alias("one"), *about)
    out = operands.unionByName(kept).groupBy(*keys).agg(
        F.when(F.count("value") > 0, merge.fold(F.col("value"), F.col("seq"), F.col("base_value"))).alias("merged"),
        F.first("base_value", ignorenulls=True).alias("base_value"),
        F.max("seq").alias("seq"),
        F.first("base_op", ignorenulls=True).alias("base_op"),
        F.sum("one").alias("n_operands"),
        *[F.first(c, ignorenulls=True).alias(c) for c in extra],
    )
    value = F.coalesce("merged", F.col("base_value").cast(dict(out.dtypes)["merged"]))
    if "columns" in extra:
        others = F.map_filter("columns", lambda k, _: k != "")
        entity = F.when(F.col("merged").isNull(), F.col("columns")).otherwise(F.map_concat(others, F.create_map(F.lit(""), F.col("merged").cast("string"))))
        out = out.withColumn("value_", F.when(F.col("columns").isNull(), value)).withColumn("columns", F.when(F.col("columns").isNotNull(), entity))
        value = F.col("value_")
    return out.select(*keys, value.alias("value"), "seq", *extra, "base_op", "n_operands")


def versions(log: DataFrame, from_ts: int, read_ts: int, snapshot: int | None = None) -> DataFrame:
    """Every version, deletes too, with a timestamp within both bounds; newest first within a key."""
    return visible(log, snapshot, read_ts, from_ts)


def operands(log: DataFrame, limit: int | None = None, **how) -> DataFrame:
    """(cf, user_key, operands, n): each key's operands and base value, oldest first. Beyond `limit` the list is null and n tells the number."""
    v = visible(log, **how)
    is_base = F.col("op") != MERGE
    base = v.filter(is_base).groupBy("cf", "user_key").agg(F.max("seq").alias("base_seq"), F.max_by("op", "seq").alias("base_op"))
    rows = v.join(base, ["cf", "user_key"], "left").filter(F.col("seq") >= F.coalesce("base_seq", F.lit(-1))).filter(~F.col("op").isin(*DELETES))
    out = rows.groupBy("cf", "user_key").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("l"), F.count("*").alias("n"))
    values = F.transform("l", lambda x: x["value"])
    return out.select("cf", "user_key", (values if limit is None else F.when(F.col("n") <= limit, values)).alias("operands"), "n")


def single_delete_misuse(log: DataFrame) -> DataFrame:
    """(cf, user_key, seq, earlier): single deletes whose key's entry before them is not exactly one put."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("cf", "user_key").orderBy("seq")
    one, two = F.lag("op", 1).over(w), F.lag("op", 2).over(w)
    seen = log.filter(F.col("op") != DELETE_RANGE).select("cf", "user_key", "seq", "op", one.alias("earlier"), two.alias("before"))
    bad = F.coalesce(~F.col("earlier").isin("PUT", "PUT_ENTITY", "TIMED_PUT"), F.lit(False)) | F.coalesce(F.col("before").isin("PUT", "PUT_ENTITY", "TIMED_PUT", MERGE), F.lit(False))
    return seen.filter((F.col("op") == "SINGLE_DELETE") & bad).select("cf", "user_key", "seq", "earlier")
