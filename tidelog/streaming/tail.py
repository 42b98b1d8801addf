"""Following a log as it grows: tailing readers, secondaries, a keyed state with expiry, and the offline drain, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dedup
from ..operators.resolve import resolve
from ..schema import DELETES, OP_LOG


def tail(spark: SparkSession, path: str, since: int = 0, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of a store's operations from a sequence number on."""
    reader = spark.readStream.schema(OP_LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}/log").filter(F.col("seq") >= since)


def catch_up(stream: DataFrame, state_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """A follower: the operations of each batch are kept as they are, a folder for each batch, so one that is done twice changes nothing.
    Without `every` it reads all that is there and stops, a secondary's catch-up; with it (such as '10 seconds') it goes on."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    out = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def follower_log(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.schema(OP_LOG).parquet(state_path).select(*OP_LOG.names)


def follower_state(spark: SparkSession, state_path: str, **how) -> DataFrame:
    """What a reader of the primary would see up to the last batch: merges, range deletes and entities resolve on read; `how` as for resolve()."""
    return resolve(follower_log(spark, state_path), **how)


def compact_follower(spark: SparkSession, state_path: str, to: str, merge: str | None = None) -> None:
    """Rewrites what a stopped follower holds as one batch that says the same to a reader; a follower that goes on from `to` needs the old checkpoint."""
    from ..operators.retention import compact

    compact(follower_log(spark, state_path), bottom=True, merge=merge).drop("stripe").write.parquet(f"{to}/batch=-1")


def offline_drain(stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Deduplicates queued batches: the newest put of each key in a batch goes into the content index, a part for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        dedup.drain(batch).write.mode("overwrite").parquet(f"{index_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_values(stream: DataFrame, ttl_s: int) -> DataFrame:
    """Each key's newest value, kept as state that is forgotten ttl_s seconds of event time after its write. stream: (user_key, seq, op, value, event_time timestamp)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, value = state.get
            state.remove()
            yield pd.DataFrame({"user_key": [key[0]], "seq": [seq], "value": [None], "live": [False]})
            return
        seq, value = state.get if state.exists else (-1, None)
        at = None
        for f in frames:
            row = f.loc[f["seq"].idxmax()]
            if int(row["seq"]) > seq:
                seq, value, at = int(row["seq"]), (None if row["op"] in DELETES else row["value"]), row["event_time"]
        if at is None:
            return
        state.update((seq, value))
        state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_key": [key[0]], "seq": [seq], "value": [value], "live": [value is not None]})

    marked = stream.withWatermark("event_time", "0 seconds")
    return marked.groupBy("user_key").applyInPandasWithState(update, "user_key string, seq long, value string, live boolean", "seq long, value string", "append", GroupStateTimeout.EventTimeTimeout)


def filtered(stream: DataFrame, *rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recovery filters: rules that skip or change entries on their way in."""
    for rule in rules:
        stream = stream.transform(rule)
    return stream


def rates(stream: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Operations by type in tumbling windows of event time."""
    return stream.withWatermark("event_time", late).groupBy(F.window("event_time", width), "op").count()
