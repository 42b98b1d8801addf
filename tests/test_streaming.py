import datetime

from pyspark.sql import functions as F

from tidelog.sources.store import Batch, Store
from tidelog.streaming import tail


def test_follower_and_drain(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(Batch().put("a", "x" * 70).put("b", "2"))
    where = [str(tmp_path / n) for n in ("state", "c1", "index", "c2")]
    tail.catch_up(tail.tail(spark, store.path), where[0], where[1]).awaitTermination()
    store.write(Batch().delete("b").put("c", "x" * 70))
    tail.catch_up(tail.tail(spark, store.path), where[0], where[1]).awaitTermination()
    assert {r["user_key"] for r in tail.follower_state(spark, where[0]).collect()} == {"a", "c"} == {r["user_key"] for r in store.state().collect()}
    tail.offline_drain(tail.tail(spark, store.path, since=3), where[2], where[3]).awaitTermination()
    assert spark.read.parquet(where[2]).first()["refcount"] == 1


def test_values_expire(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "user_key string, seq long, op string, value string, event_time timestamp"
    for i, rows in enumerate(([("a", 1, "PUT", "1", at(0))], [("b", 2, "PUT", "2", at(100))], [("b", 3, "PUT", "3", at(101))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tail.live_values(stream, 10).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("live")
    assert out.filter(F.col("user_key") == "a").filter("live").count() == 1
    assert out.filter("user_key = 'a' and not live").count() == 1
