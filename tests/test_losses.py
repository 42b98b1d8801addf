"""Nothing gets lost: numbering at size, cut logs, followers, rows without times, compaction against resolve."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ranges, retention
from tidelog.operators.resolve import resolve
from tidelog.sources.store import Batch, Store
from tidelog.streaming import tail


def state(store, **how):
    return {r["user_key"]: (r["value"], r["columns"]) for r in store.state(**how).collect()}


def test_bulk_numbers_every_row(spark, tmp_path):
    rows = spark.range(400_000).select(F.xxhash64("id").alias("ts"), F.lit("PUT").alias("op"), F.col("id").cast("string").alias("user_key"), F.repeat(F.lit("v"), 250).alias("value"))
    rows = rows.unionByName(rows.limit(0)).withColumn("ts", F.when(F.col("user_key").cast("long") % 3 == 0, 5).otherwise(F.col("ts")))  # a third of the rows share a time
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    try:
        store = Store(spark, str(tmp_path / "s"))
        store.write(Batch().put("first", "1"))
        assert store.bulk(rows, "ts") == 400_001
        n, distinct, least, most = store.log().filter("batch_id = 2").agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
        assert (n, distinct, least, most) == (400_000, 400_000, 2, 400_001)
        assert store.write(Batch().put("last", "1")) == 400_002 == store.latest_seq()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bulk_keeps_the_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), "PUT", f"k{i}", "v") for i in range(500)]
    store = Store(spark, str(tmp_path / "s"))
    store.bulk(spark.createDataFrame(rows, "ts int, op string, user_key string, value string").repartition(7), "ts")
    at = {r["user_key"]: r["seq"] for r in store.log().collect()}
    assert [t for _, t in sorted((at[k], t) for t, _, k, _ in rows)] == sorted(t for t, *_ in rows)


def test_cut_logs_keep_what_range_deletes_did(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    b = Batch()
    for k in "abcdefghijklmn":
        b.put(k, k)
    store.write(b)
    store.write(Batch().delete_range("b", "k").put("d", "new"))
    whole = state(store)
    assert set(whole) == set("adklmn")
    clipped = store.clip("c", "l", str(tmp_path / "c"))
    assert state(clipped) == {k: v for k, v in whole.items() if "c" <= k < "l"}
    assert {(r["user_key"], r["end_key"]) for r in clipped.log().filter("op = 'DELETE_RANGE'").collect()} == {("c", "k")}
    rest = store.drop_range("c", "e", str(tmp_path / "d"))
    assert state(rest) == {k: v for k, v in whole.items() if not "c" <= k < "e"}
    assert {(r["user_key"], r["end_key"]) for r in rest.log().filter("op = 'DELETE_RANGE'").collect()} == {("b", "c"), ("e", "k")}


def test_follower_sees_what_the_store_says(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path)
    where, mark = str(tmp_path / "f"), str(tmp_path / "m")
    follow = lambda: tail.catch_up(tail.tail(spark, path), where, mark).awaitTermination()
    store.write(Batch().put("a", "1").merge("n", "5").merge("n", "6").put("b", "x").put("c", "y").put_entity("e", {"": "0", "z": "9"}))
    follow()
    shown = lambda df: {r["user_key"]: (r["value"], r["columns"], r["seq"]) for r in df.collect()}
    assert shown(tail.follower_state(spark, where, merge="stringappend")) == shown(store.state(merge="stringappend"))
    store.write(Batch().delete_range("b", "d").merge("e", "7").merge("n", "8").put("c", "again"))
    store.write(Batch().delete("a"))
    follow()
    got = shown(tail.follower_state(spark, where, merge="stringappend"))
    assert got == shown(store.state(merge="stringappend"))
    assert got["n"][0] == "5,6,8" and got["e"][1] == {"": "0,7", "z": "9"} and set(got) == {"c", "e", "n"}
    tail.compact_follower(spark, where, str(tmp_path / "g"), merge="stringappend")
    assert shown(tail.follower_state(spark, str(tmp_path / "g"))) == got


def test_rows_without_times_stay(spark):
    log = spark.createDataFrame([("d", "a", 1, None, None), ("d", "b", 2, 10, 10), ("d", "b", 3, 90, 90), ("d", "c", 4, 20, 20)], "cf string, user_key string, seq long, write_time long, udt long")
    seqs = lambda df: sorted(r["seq"] for r in df.collect())
    assert seqs(retention.drop_expired(log, 30, 60)) == [1, 3]
    assert seqs(retention.trim_history(log, 50)) == [1, 2, 4]
    assert seqs(retention.drop_history_below(log, 50)) == [1, 2, 3, 4]


@pytest.mark.parametrize("bottom", [True, False])
def test_compacted_logs_say_the_same(spark, bottom):
    rng, ops = random.Random(5), []
    for seq in range(1, 700):
        op = rng.choice(["PUT", "MERGE", "MERGE", "DELETE", "DELETE_RANGE", "PUT_ENTITY"])
        key = rng.randint(0, 30)
        ops.append(("default", key, seq, op, rng.randint(0, 99) if op in ("PUT", "MERGE") else None, key + rng.randint(0, 9) if op == "DELETE_RANGE" else None, {"": str(seq), "x": "1"} if op == "PUT_ENTITY" else None))
    log = spark.createDataFrame(ops, "cf string, user_key int, seq long, op string, value long, end_key int, columns map<string,string>")
    snapshots = (100, 333, 500)
    small = retention.compact(log, snapshots, bottom=bottom, merge="sum").drop("stripe").cache()
    assert small.count() < len(ops) / 2 and small.columns == log.columns
    for s in (*snapshots, None):
        shown = lambda df, s=s: {r["user_key"]: (r["value"], r["columns"]) for r in resolve(df, s, merge="sum").collect()}
        assert shown(small) == shown(log)


def test_many_ranges_without_broadcast_joins(spark, monkeypatch):
    rng = random.Random(2)
    points = spark.createDataFrame([(k, v) for v, k in enumerate(rng.choices(range(300), k=900))], "user_key int, value int")
    spans = [(i, a := rng.randint(-5, 300), rng.choice([None, a, a + rng.randint(1, 40)])) for i in range(60)] + [(60, 0, 400)]
    table = spark.createDataFrame(spans, "range_id int, lo int, hi int")
    want = sorted((i, k, v) for i, lo, hi in spans for k, v in [(r["user_key"], r["value"]) for r in points.collect()] if lo <= k and (hi is None or k < hi))
    for few, most in ((1000, 1000), (3, 1000), (3, 7)):
        monkeypatch.setattr(ranges, "FEW", few)
        monkeypatch.setattr(ranges, "MOST", most)
        got = ranges.multi_scan(points, table)
        if few == 3:
            plan = got._jdf.queryExecution().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted((r["range_id"], r["user_key"], r["value"]) for r in got.collect()) == want


def test_newest_of_numbers_is_a_hash_aggregate(spark):
    log = spark.range(100).selectExpr("'d' as cf", "id % 7 as user_key", "id as seq", "'PUT' as op", "id as value")
    assert "SortAggregate" not in resolve(log, has_merges=False)._jdf.queryExecution().toString()
