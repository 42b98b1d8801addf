"""Transactions over a log: optimistic checks, commit visibility, a batch read over the database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import numbered


def conflicts(txn_keys: DataFrame, log: DataFrame) -> DataFrame:
    """(txn_id, user_key) tracked by a transaction at `snapshot` that a later write touched."""
    last = log.groupBy("user_key").agg(F.max("seq").alias("last_seq"))
    return txn_keys.join(last, "user_key").filter(F.col("last_seq") > F.col("snapshot")).select("txn_id", "user_key", "last_seq")


def committed(log: DataFrame, status: DataFrame) -> DataFrame:
    """Entries without a transaction, and those of committed ones (txn_id, status)."""
    done = status.filter("status = 'committed'").select("txn_id")
    return log.filter("txn_id is null").unionByName(log.filter("txn_id is not null").join(done, "txn_id", "left_semi").select(*log.columns))


def overlay(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with an uncommitted batch on top: its entries, in order, are newer than any in the log. Resolve the result."""
    top = (1 << 62)
    return log.unionByName(batch.withColumn("seq", F.col("seq") + F.lit(top)), allowMissingColumns=True)


def named_snapshots(log: DataFrame, times: DataFrame) -> DataFrame:
    """(name, time, seq): for each named time the last sequence number written at or before it."""
    marks = log.groupBy("write_time").agg(F.max("seq").alias("seq"))
    both = marks.select(F.col("write_time").alias("at"), F.lit(0).alias("k"), "seq", F.lit(None).cast("string").alias("name")).unionByName(times.select(F.col("time").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("seq"), F.col("name").cast("string").alias("name")))
    # A running maximum over write times, by parts of the time line and what enters each of them.
    rows = numbered(both, "at", "k").withColumn("part", F.floor(F.col("number") / 1_000_000))
    enter = rows.groupBy("part").agg(F.max("seq").alias("top")).select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("enter"))
    upto = F.max("seq").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).filter("k = 1").join(F.broadcast(enter), "part").select("name", F.col("at").alias("time"), F.greatest("upto", "enter").alias("seq"))


class Busy(RuntimeError):
    """A key that the transaction read for update, or wrote, has been written since its snapshot."""


class TryAgain(RuntimeError):
    """The log no longer tells what was written since the snapshot."""


class Transaction:
    """Optimistic: reads at a snapshot with its own writes on top; commit() checks the tracked keys and writes one batch."""

    def __init__(self, store, kept_from: int = 0, merge: str | None = None):
        from ..sources.store import Batch

        self.store, self.snapshot, self.kept_from, self.merge = store, store.latest_seq(), kept_from, merge
        self.batch, self.tracked = Batch(), set()

    def put(self, key: str, value: str, tracked: bool = True) -> None:
        self.batch.put(key, value)
        if tracked:
            self.tracked.add(key)

    def delete(self, key: str, tracked: bool = True) -> None:
        self.batch.delete(key)
        if tracked:
            self.tracked.add(key)

    def state(self) -> DataFrame:
        from ..schema import OP_LOG
        from .resolve import resolve

        rows = [(cf, key, udt, i, op, value, columns, end, time, None) for i, (cf, key, udt, _, op, value, columns, end, time) in enumerate(self.batch.ops)]
        log = self.store.log().filter(F.col("seq") <= self.snapshot)
        return resolve(overlay(log, self.store.spark.createDataFrame(rows, OP_LOG)) if rows else log, merge=self.merge)

    def get(self, key: str) -> str | None:
        row = self.state().filter(F.col("user_key") == key).select("value").first()
        return row[0] if row else None

    def get_for_update(self, key: str) -> str | None:
        self.tracked.add(key)
        return self.get(key)

    def undo_get_for_update(self, key: str) -> None:
        if all(op[1] != key for op in self.batch.ops):
            self.tracked.discard(key)

    def rollback(self) -> None:
        self.batch.ops.clear()
        self.tracked.clear()

    def commit(self) -> int:
        if self.tracked and self.snapshot < self.kept_from:
            raise TryAgain(f"the log begins at {self.kept_from}, the snapshot is {self.snapshot}")
        late = self.store.log().filter((F.col("seq") > self.snapshot) & F.col("user_key").isin(*self.tracked)).select("user_key").first() if self.tracked else None
        if late:
            raise Busy(late[0])
        return self.store.write(self.batch)
