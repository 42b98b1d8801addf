"""What a log or a state keeps: compaction by snapshot stripes, expiry, size caps, filters, row merges with tombstones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE_RANGE, DELETES, ENTITY, MERGE, PUT
from ..tables import numbered
from . import merge as merges
from . import ranges
from .resolve import folded


def stripe(seq: Column, snapshots: Sequence[int]) -> Column:
    """The first snapshot at or above seq; the open stripe above all of them is the largest long."""
    out = F.lit((1 << 63) - 1)
    for s in sorted(snapshots, reverse=True):
        out = F.when(seq <= s, F.lit(s)).otherwise(out)
    return out


def compact(log: DataFrame, snapshots: Sequence[int] = (), bottom: bool = True, merge: str | merges.Merge | None = None, has_ranges: bool | None = None) -> DataFrame:
    """The log's columns and stripe: what every snapshot, and the newest reader, still need of the log.

    In each snapshot stripe a key keeps its newest entry, with the operands above it folded in; operands without a base in their stripe become one
    operand, or at the bottom, where nothing older exists, the value itself. Entries that a range tombstone of their own stripe covers go. At the
    bottom a delete that nothing older needs goes, and so do range tombstones of the first stripe. Operators that can't be
    folded without their base (stringappendtest) keep their operands as they are."""
    rows = log.withColumn("stripe", stripe(F.col("seq"), snapshots))
    names = [*log.columns, "stripe"]
    is_range = F.col("op") == DELETE_RANGE
    points, dead = rows.filter(~is_range), rows.filter(is_range)
    if has_ranges is None:
        has_ranges = "end_key" in log.columns and bool(dead.head(1))
    if has_ranges:
        points = ranges.drop_covered(points, dead, by=("cf", "stripe"))
    keys = ["cf", "user_key", "stripe"]
    extra = [c for c in log.columns if c not in ("cf", "user_key", "seq", "op", "value")]
    older = F.col("stripe") > F.min("stripe").over(Window.partitionBy("cf", "user_key"))
    if points.filter(F.col("op") == MERGE).head(1):
        how = merges.named(merge)
        if how.name == "stringappendtest":
            raise NotImplementedError("operands of this operator can't be folded without their base")
        out = folded(points, keys, how, [c for c in extra if c == "columns"]).withColumn("older_", older)
        lone = F.col("base_op").isNull()
        entity = F.col("columns").isNotNull() if "columns" in extra else F.lit(False)
        op = F.when(F.col("n_operands") == 0, F.col("base_op")).when(entity, F.lit(ENTITY)).when(lone & (F.col("older_") | F.lit(not bottom)), F.lit(MERGE)).otherwise(F.lit(PUT))
        out = out.withColumn("op", op).drop("base_op", "n_operands")
        rest = [c for c in extra if c != "columns"]
        if rest:  # what the newest entry of the stripe says besides its value
            out = out.join(points.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("x_")), keys).select("*", "x_.*").drop("x_")
    else:
        out = points.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), "seq").alias("e")).select(*keys, "e.*").withColumn("older_", older)
    if bottom:
        out = out.filter(~F.col("op").isin(*DELETES) | F.col("older_"))
    out = out.select([F.col(c).cast(k).alias(c) for c, k in rows.dtypes])
    if has_ranges:
        first = min(snapshots, default=(1 << 63) - 1)
        out = out.unionByName(dead.filter(F.col("stripe") > first) if bottom else dead)
    return out.select(*names)


def expired(write_time: Column, ttl: Column | int, now: Column | int) -> Column:
    """ttl of 0 or less never expires; a row expires when write_time + ttl < now. A row without a write time does not."""
    ttl = F.lit(ttl) if isinstance(ttl, int) else ttl
    now = F.lit(now) if isinstance(now, int) else now
    return F.coalesce((ttl > 0) & (write_time + ttl < now), F.lit(False))


def drop_expired(state: DataFrame, ttl: Column | int, now: Column | int, strict: bool = True) -> DataFrame:
    """strict=False leaves expired rows readable, as until a compaction."""
    return state.filter(~expired(F.col("write_time"), ttl, now)) if strict else state


def fifo(files: DataFrame, ttl: int | None, cap: int | None, now: int) -> DataFrame:
    """The files (file_id, newest, size) that go, oldest first: those before the first one still within ttl; if the rest exceeds
    the cap, files go by size only."""
    order = Window.orderBy("newest", "file_id")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rows = files.withColumn("keep_size", F.sum("size").over(after))
    old = F.lit(False)
    if ttl is not None and ttl > 0:
        fresh = F.max((F.col("newest") >= now - ttl).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        old = fresh == 0
    rows = rows.withColumn("old", old)
    if cap is not None:
        left = F.sum(F.when(~F.col("old"), F.col("size")).otherwise(0)).over(Window.partitionBy())
        rows = rows.withColumn("by_size", left > cap)
        return rows.filter(F.when(F.col("by_size"), F.col("keep_size") > cap).otherwise(F.col("old"))).select(*files.columns)
    return rows.filter("old").select(*files.columns)


def size_drop(files: DataFrame, cap: int) -> DataFrame:
    return fifo(files, None, cap, 0)


def filtered(log: DataFrame, *rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compaction filters: functions of a DataFrame that keep, drop or change rows, in order."""
    for rule in rules:
        log = log.transform(rule)
    return log


def remove_empty_values(log: DataFrame) -> DataFrame:
    return log.filter(F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit(""))) > 0)


def _cut(log: DataFrame, key: str, *kept: tuple) -> DataFrame:
    """log within the half-open key ranges: other entries by their keys, range tombstones cut to what lies inside. None is an open end."""
    inside, pieces = F.lit(False), None
    for lo, hi in kept:
        here = F.lit(True)
        if lo is not None:
            here = here & (F.col(key) >= F.lit(lo))
        if hi is not None:
            here = here & (F.col(key) < F.lit(hi))
        inside = inside | here
    if "end_key" not in log.columns:
        return log.filter(inside)
    is_range = F.col("op") == DELETE_RANGE
    kinds = dict(log.dtypes)
    for lo, hi in kept:
        part = log.filter(is_range)
        if lo is not None:
            part = part.withColumn(key, F.greatest(key, F.lit(lo).cast(kinds[key])))
        if hi is not None:
            part = part.withColumn("end_key", F.least("end_key", F.lit(hi).cast(kinds["end_key"])))
        part = part.filter(F.col(key) < F.col("end_key")).select(*log.columns)
        pieces = part if pieces is None else pieces.unionByName(part)
    return log.filter(~is_range & inside).unionByName(pieces)


def clip(log: DataFrame, lo, hi, key: str = "user_key") -> DataFrame:
    """What the log says of keys in [lo, hi): a range tombstone that reaches in from outside still deletes there."""
    return _cut(log, key, (lo, hi))


def cut_out(log: DataFrame, lo, hi, key: str = "user_key") -> DataFrame:
    """What the log says of keys outside [lo, hi); a range tombstone over it is split in two."""
    return _cut(log, key, (None, lo), (hi, None))


def trim_history(log: DataFrame, newest: int) -> DataFrame:
    """Drops everything with a user timestamp above `newest`; an entry without one stays."""
    return log.filter(F.col("udt").isNull() | (F.col("udt") <= newest))


def drop_history_below(log: DataFrame, low: int) -> DataFrame:
    """Keeps every version at or above `low`, those without a timestamp and, of each key, the newest one below it."""
    below = F.max(F.when(F.col("udt") < low, F.struct("udt", "seq"))).over(Window.partitionBy("cf", "user_key"))
    return log.withColumn("b_", below).filter(F.col("udt").isNull() | (F.col("udt") >= low) | ((F.col("udt") == F.col("b_.udt")) & (F.col("seq") == F.col("b_.seq")))).drop("b_")


def deletion_windows(log: DataFrame, size: int = 128, deletes: int = 50, ratio: float = 0.0, by: Sequence[str] = ("cf",), chunk: int = 1_000_000) -> DataFrame:
    """(by.., compact): whether some `size` entries in a row, rounded up to a multiple of 128, hold enough deletes, or the whole has the ratio.

    Entries are numbered in key order and looked at in chunks, each with the size - 1 entries before it, so a family is not one task."""
    size = -(-size // 128) * 128
    gone = F.col("op").isin(*DELETES).cast("int")
    rows = numbered(log.select(*by, "user_key", (-F.col("seq")).alias("back_"), gone.alias("gone")), *by, "user_key", "back_").withColumn("at_", F.col("number") - 1)
    own = F.floor(F.col("at_") / chunk)
    tail = F.col("at_") % chunk > chunk - size
    rows = rows.withColumn("chunk_", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("lent_", F.col("chunk_") != own)
    w = Window.partitionBy(*by, "chunk_").orderBy("at_").rowsBetween(-(size - 1), 0)
    near = rows.withColumn("near", F.sum("gone").over(w)).filter(~F.col("lent_"))
    dense = F.max("near") >= deletes
    return near.groupBy(*by).agg((dense | ((F.avg("gone") >= ratio) if ratio > 0 else F.lit(False))).alias("compact"))


def storage_tier(age: Column, warm: int, cold: int) -> Column:
    return F.when(age < warm, "hot").when(age < cold, "warm").otherwise("cold")


def seqno_to_time(log: DataFrame, samples: DataFrame) -> DataFrame:
    """log with the time of the last sample (seq, time) at or before each entry."""
    both = log.withColumn("time", F.lit(None).cast("long")).withColumn("k_", F.lit(1))
    marks = samples.select(F.col("seq"), F.col("time").cast("long"), F.lit(0).alias("k_"))
    width = 1 << 20
    cell = F.floor(F.col("seq") / width)
    rows = both.unionByName(marks, allowMissingColumns=True).withColumn("c_", cell)
    here = F.last("time", True).over(Window.partitionBy("c_").orderBy("seq", "k_").rowsBetween(Window.unboundedPreceding, 0))
    # What enters a cell is the last mark of the cells before it: one row for each cell is sorted in one task.
    cells = rows.groupBy("c_").agg(F.max_by("time", F.when(F.col("k_") == 0, F.col("seq"))).alias("last_"))
    enter = cells.select("c_", F.last("last_", True).over(Window.orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)).alias("carry_"))
    return rows.withColumn("time", here).filter("k_ = 1").join(enter, "c_", "left").withColumn("time", F.coalesce("time", "carry_")).drop("c_", "k_", "carry_")


def ttl_merge(log: DataFrame, ttl: int, now: int, merge: str | merges.Merge) -> DataFrame:
    """(cf, user_key, value, seq, write_time) of a log whose values age: each operand and base counts while it is not expired, and the folded value is as old
    as its newest part."""
    live = log.filter(~expired(F.col("write_time"), ttl, now))
    out = folded(live, ["cf", "user_key"], merges.named(merge))
    newest = live.groupBy("cf", "user_key").agg(F.max("write_time").alias("write_time"))
    out = out.filter((F.col("n_operands") > 0) | ~F.col("base_op").isin(*DELETES)).select("cf", "user_key", "value", "seq")
    return out.join(newest, ["cf", "user_key"])


def level_scores(files: DataFrame, base: int, factor: int, trigger: int = 4) -> DataFrame:
    """(level, n, size, target, score) of a leveled store's files (level, size): level 0 by its number of files, others by size against base * factor ** (level - 1).
    The level with the highest score of 1 or more is compacted next."""
    per = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    target = F.when(F.col("level") == 0, F.lit(trigger).cast("double")).otherwise(F.lit(float(base)) * F.pow(F.lit(float(factor)), F.col("level") - 1))
    score = F.when(F.col("level") == 0, F.col("n") / trigger).otherwise(F.col("size") / target)
    return per.withColumn("target", target).withColumn("score", F.round(score, 6))


def universal_runs(runs: DataFrame, most_amplification: int = 200, ratio: int = 1) -> DataFrame:
    """(run, size, newer, amplified, joins) of sorted runs (run: 0 the newest): amplified where all newer runs exceed most_amplification percent of the oldest one; joins
    where the run is no larger than the newer ones together and `ratio` percent more, so that a merge of these takes it along."""
    w = Window.orderBy("run")
    newer = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("run") == F.max("run").over(Window.partitionBy())
    out = runs.withColumn("newer", newer)
    return out.withColumn("amplified", last & (F.col("newer") * 100 > F.col("size") * most_amplification)).withColumn("joins", (F.col("newer") > 0) & (F.col("size") * 100 <= F.col("newer") * (100 + ratio)))


def merge_rows(cells: DataFrame, key: str = "user_key") -> DataFrame:
    """Wide rows merged column by column. cells: (key, seq, column, kind, ts, value), kind 'column' or 'tombstone', or 'row_tombstone' with a null column.

    Each column takes its latest timestamp (ties: the later write); columns at or below the row's latest tombstone are dropped."""
    dead = cells.filter("kind = 'row_tombstone'").groupBy(key).agg(F.max("ts").alias("dead_ts"))
    best = cells.filter("kind <> 'row_tombstone'").groupBy(key, "column").agg(F.max(F.struct("ts", "seq", "kind", "value")).alias("b"))
    out = best.join(dead, key, "left").filter(F.col("dead_ts").isNull() | (F.col("b.ts") > F.col("dead_ts")))
    return out.select(key, "column", "b.kind", "b.ts", "b.value")


def expire_columns(columns: DataFrame, now_us: int, gc_grace_s: int, purge: bool = False) -> DataFrame:
    """Expiring columns past their ttl become tombstones (or go, with purge); tombstones older than the grace period go."""
    over = (F.col("ttl") > 0) & (F.col("ts") + F.col("ttl") * 1_000_000 <= now_us)
    kept = columns.filter(~over) if purge else columns.withColumn("kind", F.when(over & (F.col("kind") == "column"), "tombstone").otherwise(F.col("kind")))
    return kept.filter(~((F.col("kind") == "tombstone") & (F.col("ts") + gc_grace_s * 1_000_000 <= now_us)))
