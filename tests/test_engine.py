"""The log against a dict, merge operators, ranges, retention, the store and the simulators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.functions import expressions as X
from tidelog.operators import cache_trace, dedup, index, merge, multicf, ranges, retention, scan
from tidelog.operators.resolve import operands, resolve, single_delete_misuse
from tidelog.sources.store import Batch, Store, read_tsv, workload

LOG = "cf string, user_key int, seq long, op string, value long, end_key int"


def model(ops, snapshot):
    state = {}
    for _, key, seq, op, value, end in ops:
        if seq > snapshot:
            break
        if op == "PUT":
            state[key] = value
        elif op == "MERGE":
            state[key] = state.get(key, 0) + value
        elif op == "DELETE_RANGE":
            state = {k: v for k, v in state.items() if not key <= k < end}
        else:
            state.pop(key, None)
    return state


def random_ops(n, seed):
    rng, out = random.Random(seed), []
    for seq in range(1, n + 1):
        op = rng.choice(["PUT", "PUT", "MERGE", "MERGE", "DELETE", "SINGLE_DELETE", "DELETE_RANGE"])
        key = rng.randint(0, 40)
        out.append(("default", key, seq, op, rng.randint(0, 99) if op in ("PUT", "MERGE") else None, key + rng.randint(0, 12) if op == "DELETE_RANGE" else None))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_resolve_equals_dict(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(ranges, "FEW", 3)  # the fragment path
    ops = random_ops(600, 11)
    log = spark.createDataFrame(ops, LOG)
    for snapshot in (1, 77, 600):
        got = {r["user_key"]: r["value"] for r in resolve(log, snapshot, merge="sum").collect()}
        assert got == model(ops, snapshot)


def test_resolve_needs_a_merge_operator(spark):
    log = spark.createDataFrame([("default", 1, 1, "MERGE", 5, None)], LOG)
    with pytest.raises(ValueError, match="no merge operator"):
        resolve(log)
    with pytest.raises(ValueError, match="nosuch"):
        resolve(log, merge="nosuch")


def test_merge_over_an_entity(spark):
    rows = [("default", "a", 1, "PUT_ENTITY", None, {"": "b", "x": "1"}), ("default", "a", 2, "MERGE", "m", None), ("default", "c", 3, "PUT", "v", None), ("default", "c", 4, "MERGE", "w", None), ("default", "e", 5, "PUT_ENTITY", None, {"x": "2"})]
    log = spark.createDataFrame(rows, "cf string, user_key string, seq long, op string, value string, columns map<string,string>")
    got = {r["user_key"]: (r["value"], r["columns"]) for r in resolve(log, merge="stringappend").collect()}
    assert got == {"a": (None, {"": "b,m", "x": "1"}), "c": ("v,w", None), "e": (None, {"x": "2"})}


def test_single_delete_misuse(spark):
    ops = [("default", 1, 1, "PUT", 1, None), ("default", 1, 2, "SINGLE_DELETE", None, None), ("default", 2, 3, "PUT", 1, None), ("default", 2, 4, "PUT", 2, None), ("default", 2, 5, "SINGLE_DELETE", None, None)]
    assert [r["seq"] for r in single_delete_misuse(spark.createDataFrame(ops, LOG)).collect()] == [5]


def test_merge_operand_list_and_limit(spark):
    ops = [("default", 1, 1, "PUT", 1, None), ("default", 1, 2, "MERGE", 2, None), ("default", 1, 3, "MERGE", 3, None)]
    log = spark.createDataFrame(ops, LOG)
    assert operands(log).first()["operands"] == [1, 2, 3]
    row = operands(log, limit=2).first()
    assert row["operands"] is None and row["n"] == 3


def fold(spark, name, values, base, kind):
    rows = [(i, v, base) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"seq long, value {kind}, base {kind}")
    return df.groupBy().agg(merge.REGISTRY[name].fold(F.col("value"), F.col("seq"), F.col("base")).alias("x")).first()["x"]


def test_named_merges(spark):
    assert fold(spark, "stringappend", ["b", "c"], "", "string") == ",b,c"
    assert fold(spark, "stringappend", ["b", "c"], None, "string") == "b,c"
    assert fold(spark, "sortlist", ["3,9", "1,3"], "7", "string") == "1,3,3,9"
    assert fold(spark, "max", ["a", "b"], "c", "string") == "c"
    assert fold(spark, "put", [1, 2], 9, "long") == 2
    assert fold(spark, "mul", [2, 3], 7, "long") == 42
    assert fold(spark, "uint64add", [2**63 - 1, 2**63 - 1], 5, "long") == 3
    assert merge.xor_bytes(b"\x01\x02\x03", b"\x01") == b"\x00\x02\x03"


def test_functions_that_change():
    f = merge.fold_named
    assert f([("sum", 10), ("sum", 20), ("sum", 15)]) == ("sum", 45)
    assert f([("", 30), ("sum", 10), ("sum", 20)]) == ("sum", 60)
    assert f([("last3", ["a", "b"]), ("last3", ["c", "d", "e"]), ("last3", ["f"])]) == ("last3", ["f", "c", "d"])
    assert f([("mul", 10), ("mul", 20), ("sum", 30), ("sum", 40)]) == ("sum", 270)
    assert f([("mul", 10), ("mul", 10), ("mul", 10), ("sum", 10)]) == ("sum", 1010)
    assert f([("nosuch", 1), ("sum", 2)]) == (merge.ERROR, [1, 2])


def test_bytes_xor_and_counters(spark):
    df = spark.createDataFrame([(1, 1, b"\x01\x02", None), (1, 2, b"\x03", None)], "user_key int, seq long, value binary, base binary")
    assert bytes(merge.bytes_xor(df).first()["value"]) == b"\x02\x02"
    c = spark.createDataFrame([(b"\x05\x01\0\0\0\0\0\0",), (b"\x05",)], "v binary").select(X.counter(F.col("v")).alias("n")).collect()
    assert [int(r["n"]) for r in c] == [261, 0]
    assert bytes(spark.range(1).select(X.counter_bytes(F.lit("18446744073709551617").cast("decimal(20,0)")).alias("b")).first()["b"]) == b"\x01" + bytes(7)
    assert X.crc32c_of(b"123456789") == 0xE3069283
    row = spark.createDataFrame([("abcd", "abxd", "abcd")], "a string, b string, c string").select(X.difference_offset(F.col("a"), F.col("b")).alias("x"), X.difference_offset(F.col("a"), F.col("c")).alias("y")).first()
    assert (row["x"], row["y"]) == (2, 4)


def test_fragments(spark):
    rt = spark.createDataFrame([(1, 10, 5), (4, 6, 9), (8, 12, 2), (7, 7, 1)], "user_key int, end_key int, seq long")
    got = sorted((r["lo"], r["hi"], r["top_seq"], r["n"]) for r in ranges.fragments(rt).collect())
    assert got == [(1, 4, 5, 1), (4, 6, 9, 2), (6, 8, 5, 1), (8, 10, 5, 2), (10, 12, 2, 1)]


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_fragments_equal_a_count_over_points(spark, buckets):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]), (a := rng.randint(0, 60)), a + rng.randint(-2, 25), i) for i in range(80)]
    out = ranges.fragments(spark.createDataFrame(rows, "cf string, user_key int, end_key int, seq long"), by=("cf",), buckets=buckets).collect()
    for cf in "ab":
        for x in range(90):
            over = [s for c, a, z, s in rows if c == cf and a <= x < z]
            got = [(r["top_seq"], r["n"]) for r in out if r["cf"] == cf and r["lo"] <= x < r["hi"]]
            assert got == ([(max(over), len(over))] if over else [])


def test_coalesce_and_groups(spark):
    one = spark.createDataFrame([("k", {"col_1": "foo", "col_2": "baz"})], "user_key string, columns map<string,string>")
    two = spark.createDataFrame([("k", {"col_2": "quux", "col_3": "bla"})], "user_key string, columns map<string,string>")
    assert multicf.coalesce([("a", one), ("b", two)]).first()["columns"] == {"col_1": "foo", "col_2": "quux", "col_3": "bla"}
    groups = multicf.attribute_groups([("a", one), ("b", two)])
    assert [g["cf"] for g in groups.first()["groups"]] == ["a", "b"]
    assert {r["cf"] for r in multicf.split_groups(groups).collect()} == {"a", "b"}


def test_entities(spark):
    df = spark.createDataFrame([("a", "v", None), ("b", None, {"": "d", "x": "1"}), ("c", None, {"x": "1"})], "user_key string, value string, columns map<string,string>")
    assert [r["value"] for r in scan.default_column(df).orderBy("user_key").collect()] == ["v", "d", ""]
    assert scan.get_entity(df).orderBy("user_key").first()["columns"] == {"": "v"}


def test_knn_self_first(spark):
    rng = np.random.default_rng(42)
    rows = [(i, [float(x) for x in rng.random(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = index.knn(v, q, 3).collect()
    assert {(r["query_id"], r["vec_id"]) for r in exact if r["rank"] == 1} == {(i, i) for i in range(5)}
    centres = index.train(v, 4)
    every = {(r["query_id"], r["rank"], r["vec_id"]) for r in index.knn_ivf(v, q, centres, 3, 4).collect()}
    assert every == {(r["query_id"], r["rank"], r["vec_id"]) for r in exact}
    with pytest.raises(ValueError, match="at most"):
        index.knn(v, q, 3, most_queries=2)


def test_retention(spark):
    files = spark.createDataFrame([(1, 10, 50), (2, 20, 50), (3, 30, 50)], "file_id int, newest long, size long")
    ids = lambda df: sorted(r["file_id"] for r in df.collect())
    assert ids(retention.fifo(files, 15, None, 30)) == [1]
    assert ids(retention.fifo(files, None, 100, 30)) == [1]
    assert ids(retention.fifo(files, 15, 60, 30)) == [1, 2]  # still over the cap: by size
    cols = spark.createDataFrame([("k", 1, 1_000_000, 10, "column", "v"), ("k", 2, 1_000_000, 0, "column", "w")], "user_key string, column int, ts long, ttl int, kind string, value string")
    assert [r["kind"] for r in retention.expire_columns(cols, 20_000_000, 100).orderBy("column").collect()] == ["tombstone", "column"]
    assert retention.expire_columns(cols, 20_000_000, 100, purge=True).count() == 1


def test_dedup_ratio(spark):
    values = [(f"k{i}", i, f"{i % 4}" * 64) for i in range(20)]
    s = dedup.stats(spark.createDataFrame(values, "user_key string, seq long, value string")).first()
    assert (s["hits"], s["misses"]) == (16, 4)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.latest_seq() == 0
    b = Batch().put("a", "1").put("b", "2")
    b.set_savepoint()
    b.put("c", "3")
    b.rollback()
    assert store.write(b) == 2
    store.write(Batch().delete("a").put_entity("e", {"y": "2", "x": "1"}).delete_range("p", "q"))
    with pytest.raises(ValueError):
        Batch().delete_range("z", "a")
    state = {r["user_key"]: r["value"] for r in store.state().collect()}
    assert state == {"b": "2", "e": None}
    assert {r["user_key"] for r in store.state(snapshot=2).collect()} == {"a", "b"}
    store.ingest(spark.createDataFrame([("b", "old"), ("n", "new")], "user_key string, value string"), behind=True)
    assert {r["user_key"]: r["value"] for r in store.state().collect()}["b"] == "2"
    with pytest.raises(ValueError, match="distinct"):
        store.ingest(spark.createDataFrame([("b", "1"), ("b", "2")], "user_key string, value string"))
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).verify()
    small = store.compact(str(tmp_path / "small"))
    assert {(r["user_key"], r["value"]) for r in small.state().collect()} == {("b", "2"), ("e", None), ("n", "new")}
    assert store.files().count() >= 3 and store.families() == ["default"]
    with pytest.raises(NotImplementedError):
        Store(spark, str(tmp_path / "d"), dedup=True).write(Batch().merge("a", "1"))
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "s"), read_only=True).write(Batch().put("a", "1"))


def test_bulk_numbers_rows_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"))
    store.bulk(spark.range(50).select((50 - F.col("id")).alias("t"), F.lit("PUT").alias("op"), F.col("id").cast("string").alias("user_key"), F.col("id").cast("string").alias("value")), "t")
    got = [(r["seq"], r["user_key"]) for r in store.updates_since(1).collect()]
    assert got == [(i + 1, str(49 - i)) for i in range(50)]


def test_replay_and_advice(spark, tmp_path):
    from tidelog.operators import advisor, trace
    from tidelog.schema import TRACE_TYPES

    store = Store(spark, str(tmp_path / "r"))
    rows = [(5, TRACE_TYPES["put"], 0, "a", 3), (9, TRACE_TYPES["delete"], 0, "a", 0), (7, TRACE_TYPES["put"], 1, "b", 2), (8, TRACE_TYPES["get"], 1, "b", 2)]
    trace.replay(spark.createDataFrame(rows, "ts long, type int, cf_id int, key string, value_size long"), store)
    assert {(r["cf"], r["user_key"], r["value"]) for r in store.state().collect()} == {("1", "b", "xx")}
    metrics = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.2), ("b", 1, 0.1)], "entity string, ts long, stall_ratio double")
    out = advisor.advise(metrics, [advisor.Rule("stalls", "stall_ratio > 0.5", "raise the write buffer")])
    assert [(r["entity"], r["rule"], r["n"]) for r in out.collect()] == [("a", "stalls", 1)]
    bursts = advisor.bursts(metrics, "stall_ratio", 1, 0.5)
    assert [r["ts"] for r in bursts.collect()] == [2]


def test_tsv_and_workload(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\nno tab\n\tempty key\n")
    assert {(r["user_key"], r["value"]) for r in read_tsv(spark, str(tmp_path / "t.tsv")).collect()} == {("a", "b\tc"), ("", "empty key")}
    w = workload(spark, 100, 400)
    assert w.filter("op = 'insert'").count() >= 100 and w.select("op").distinct().count() == 4


def naive_lru(keys, sizes, capacity):
    held, misses = [], 0
    size_of = {}
    for k, s in zip(keys, sizes, strict=True):
        if k in held:
            held.remove(k)
            held.append(k)
            continue
        misses += 1
        while held and sum(size_of[x] for x in held) + s > capacity:
            held.pop(0)
        held.append(k)
        size_of[k] = s
    return misses


def test_reuse_distance_and_simulators(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 12), 10) for i in range(400)]
    t = spark.createDataFrame(rows, "ts long, block_key long, block_size long")
    keys, sizes = [r[1] for r in rows], [10] * 400
    for capacity in (30, 60, 100):
        want = naive_lru(keys, sizes, capacity)
        assert cache_trace.lru_miss_curve(t, [capacity]).first()["misses"] == want
        got = {r["policy"]: r["misses"] for r in cache_trace.simulate(t, ["lru", "opt", "fifo", "random", "hyperbolic", "arc", "thompson"], [capacity]).collect()}
        assert got["lru"] == want and got["opt"] <= min(got.values())


def test_registered_reuse_distances_span_the_trace(spark, small, monkeypatch):
    from __spark_entry__ import queries
    from tidelog.plans import inputs

    monkeypatch.setattr(cache_trace, "SLOT", 700)
    rows = inputs.block_trace(spark, small).select("ts", "block_key", "block_size").orderBy("ts", "block_key").collect()
    stack, want = {}, []  # blocks by their last access, the latest at the end
    for r in rows:
        later, distance = 0, -1
        for k in reversed(stack) if r["block_key"] in stack else ():
            if k == r["block_key"]:
                distance = later
                break
            later += stack[k]
        stack.pop(r["block_key"], None)
        stack[r["block_key"]] = r["block_size"]
        want.append((r["block_key"], r["ts"], r["block_size"], distance))
    assert sorted(map(tuple, queries()["cache_reuse_distance"](spark, small).collect())) == sorted(want)
    for r in queries()["cache_miss_curve"](spark, small).collect():
        assert r["n"] == len(want) and r["misses"] == sum(d < 0 or d + s > r["capacity"] for _, _, s, d in want)


def test_reuse_distances_of_changing_sizes(spark, monkeypatch):
    monkeypatch.setattr(cache_trace, "SLOT", 37)
    rng = random.Random(5)
    rows = [(i, min(rng.randint(0, 40), rng.randint(0, 40)), rng.randint(1, 9)) for i in range(500)]
    want, last = [], {}
    for i, k, size in rows:
        between = {x: s for _, x, s in rows[last[k] + 1 : i]} if k in last else None
        want.append((k, i, size, -1 if between is None else sum(between.values())))
        last[k] = i
    t = spark.createDataFrame(rows, "ts long, block_key long, block_size long")
    assert sorted(map(tuple, cache_trace.reuse_distances(t).collect())) == sorted(want)
    assert cache_trace.reuse_distances(t.limit(0)).count() == 0


def test_thompson_keeps_blocks_between_windows():
    keys = list(range(300)) * 3
    assert cache_trace._simulate("thompson", keys, [10] * 900, 3000) == 300  # all fit: each block misses once
    rng = random.Random(4)
    keys = [rng.randint(0, 99) for _ in range(2000)]
    assert cache_trace._bandit(keys, [10] * 2000, 300, ("lru",)) == naive_lru(keys, [10] * 2000, 300)


def test_simulators_hold_no_trace(spark):
    """Accesses reach the simulators in batches, once for all policies, and give what the whole shard in memory does; ties of ts go by block."""
    rng, policies = random.Random(6), ["lru", "fifo", "mru", "lfu", "gdsize", "opt", "arc", "hyperbolic", "thompson", "random"]
    rows = [(rng.randint(0, 300), k, 10 + k % 7) for k in (min(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(2000))]
    t = spark.createDataFrame(rows, "ts long, block_key long, block_size long")
    shard = {r["block_key"]: r["s"] for r in t.select("block_key", F.pmod(F.xxhash64("block_key"), F.lit(3)).alias("s")).distinct().collect()}
    want = dict.fromkeys(policies, 0)
    for s in range(3):
        own = sorted(r for r in rows if shard[r[1]] == s)
        for p in policies:
            want[p] += cache_trace._simulate(p, [r[1] for r in own], [r[2] for r in own], 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = cache_trace.simulate(t, policies, [900], 3)
        assert {r["policy"]: r["misses"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Generate" not in plan
    taken = []

    def batches():
        for i in range(50):
            taken.append(i)
            yield pa.RecordBatch.from_pydict({"shard_": [i // 20] * 10, "block_key": list(range(10)), "block_size": [1] * 10})

    first = next(cache_trace._shards([("lru", 60)], 3)(batches())).to_pydict()
    assert first == {"policy": ["lru"], "capacity": [60], "n": [200], "misses": [10]} and len(taken) == 21


def test_knn_blocks_of_any_vectors(spark, monkeypatch):
    """Blocks give what a plain comparison of all pairs does, with ties within the rounding, equal vectors, nulls, other lengths and NaN; and no number of queries is too high."""
    monkeypatch.setattr(index, "VECTORS", 70)
    monkeypatch.setattr(index, "QUERIES", 9)
    rng, nan = np.random.default_rng(3), float("nan")
    some = [[float(x) for x in rng.random(4)] for _ in range(40)]
    rows = [(i, [x + float(rng.choice([0, 1e-7])) for x in some[rng.integers(0, 40)]]) for i in range(300)]
    rows += [(300, None), (301, [0.5, None, 0.5, 0.5]), (302, [0.5, 0.5]), (303, [nan, 0.1, 0.2, 0.3]), (304, [float("inf"), 0.1, 0.2, 0.3]), (305, []), (306, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 10 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for k in (3, 400):
        plain = v.crossJoin(q).select("query_id", "vec_id", F.round(X.l2(F.col("embedding"), F.col("query")), 6).alias("distance"))
        want = index._ranked(plain, k)
        assert sorted(map(repr, index.knn(v, q, k).collect())) == sorted(map(repr, want.collect()))
    assert index.knn(v.filter("vec_id < 0"), q, 3).count() == 0
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(0.0)).alias("query"))
    monkeypatch.setattr(index, "QUERIES", 4096)
    assert index.knn(spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<double>"), many, 3).filter("distance = 4.0 and rank = 1").count() == 10_001


def _shuffled_rows(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_reuse_distances_shuffle_little(spark, monkeypatch):
    """An access is shuffled once into its slot; after that only each slot's first and last accesses of a block are."""
    for slot, most in ((1 << 16, 1.2), (2000, 1.5)):
        monkeypatch.setattr(cache_trace, "SLOT", slot)
        t = spark.range(20_000).select(F.col("id").alias("ts"), (F.col("id") * 7919 % 50).alias("block_key"), F.lit(10).cast("long").alias("block_size"))
        before = _shuffled_rows(spark)
        got = cache_trace.reuse_distances(t).groupBy("distance").count().collect()
        assert sorted((r["distance"], r["count"]) for r in got) == [(-1, 50), (490, 19_950)]
        assert _shuffled_rows(spark) - before < most * 20_000
    t = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate([("a", 1), (None, 2), ("b", 4), (None, 8), ("a", 16), ("b", 1)])], "ts long, block_key string, block_size int")
    for slot in (1, 2, 9):
        monkeypatch.setattr(cache_trace, "SLOT", slot)
        assert [r["distance"] for r in cache_trace.reuse_distances(t).orderBy("ts").collect()] == [-1, -1, -1, 4, 12, 24]
