"""Transactions, batch visitors, checksums, codecs, windows of deletes in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import expressions as X
from tidelog.operators import merge, retention
from tidelog.operators.txn import Busy, Transaction, TryAgain
from tidelog.sources.store import Batch, Store


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(Batch().put("a", "1").put("b", "2"))
    one, two = Transaction(store), Transaction(store)
    assert one.get_for_update("a") == "1"
    one.put("a", "one")
    two.put("a", "two")
    assert one.get("a") == "one" and two.get("a") == "two" and two.get("c") is None
    assert one.commit() == 3
    with pytest.raises(Busy, match="a"):
        two.commit()
    three = Transaction(store)
    three.put("b", "x", tracked=False)
    three.get_for_update("a")
    three.undo_get_for_update("a")
    store.write(Batch().put("a", "again").put("b", "y"))
    assert three.commit() == 6
    old = Transaction(store, kept_from=10)
    old.delete("a")
    with pytest.raises(TryAgain):
        old.commit()
    old.rollback()
    assert old.get("a") == "again" and old.commit() == 6
    assert {r["user_key"]: r["value"] for r in store.state().collect()} == {"a": "again", "b": "x"}


def test_batch_visitor():
    seen = []

    class Puts:
        def put(self, key, value, **_):
            seen.append((key, value))

        def delete_range(self, key, end, **_):
            seen.append((key, end))

    Batch().put("a", "1").merge("a", "2").delete_range("b", "c").each(Puts())
    assert seen == [("a", "1"), ("b", "c")]


def test_checksums_and_codecs(spark):
    assert X.crc32c_many([b"123456789", b"", b"a" * 300, b"12"]) == [0xE3069283, 0, X.crc32c_of(b"a" * 300), X.crc32c_of(b"12")]
    rows = spark.createDataFrame([(i, bytes(random.Random(i).randbytes(i * 7))) for i in range(20)] + [(20, None)], "i int, raw binary")
    crc = X.crc32c(F.col("raw"))
    got = rows.select("i", "raw", crc.alias("c"), X.unmasked(X.masked(crc)).alias("u")).collect()
    assert all(r["c"] == r["u"] == (None if r["raw"] is None else X.crc32c_of(bytes(r["raw"]))) for r in got)
    for name in X.CODECS:
        back = rows.select("raw", X.decompressed(X.compressed(F.col("raw"), name), name).alias("b")).collect()
        assert all(r["raw"] == r["b"] for r in back)
    with pytest.raises(ValueError):
        X.compressed(F.col("raw"), "none such")


@pytest.mark.parametrize("chunk", [150, 1_000_000])
def test_deletion_windows_over_chunks(spark, chunk):
    for place in (0, 100, 140, 300):
        ops = [("a", i, i, "DELETE" if place <= i < place + 60 or i % 40 == 0 else "PUT") for i in range(500)] + [("b", i, i, "PUT") for i in range(90)]
        log = spark.createDataFrame(ops, "cf string, user_key int, seq long, op string")
        most = max(sum(o[3] == "DELETE" for o in ops[max(0, k - 127) : k + 1]) for k in range(500))
        for bound in (most, most + 1):
            got = {r["cf"]: r["compact"] for r in retention.deletion_windows(log, 100, bound, chunk=chunk).collect()}
            assert got == {"a": bound == most, "b": False}


def test_function_changes_fold_alike(spark):
    rng, rows = random.Random(4), []
    functions = {"sum": sum, "max": max, "min": min}
    want = {}
    for key in range(60):
        ops = [(rng.choice(["sum", "sum", "max", "min", "", "odd"][: rng.choice([4, 5, 6])] if i else ["", "sum"]), rng.randint(0, 99)) for i in range(rng.randint(1, 6))]
        rows += [(key, i, f, v) for i, (f, v) in enumerate(ops)]
        want[key] = merge.fold_named(ops, functions)
    got = {r["user_key"]: (r["func"], r["value"]) for r in merge.fold_segments(spark.createDataFrame(rows, "user_key int, seq int, func string, value long")).collect()}
    assert got == {k: (f, None if f == merge.ERROR else v) for k, (f, v) in want.items()}
    assert len({f for f, _ in want.values()}) == 4


def test_varints_of_four_bytes_and_more(spark):
    """As util/coding.cc of the reference writes them; the SQL of `encodings` ends at three bytes."""

    def plain(n):
        out = []
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n]).hex().upper()

    numbers = [0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 22, 5_999_999, 1 << 28, 1 << 35, (1 << 63) - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.varint(F.col("n")).alias("v")).collect()
    assert {r["n"]: r["v"] for r in got} == {n: plain(n) for n in numbers}


def test_codecs_take_few_values_at_once(spark, tmp_path):
    """No Arrow batch of values of any size, and documents are read once for all codecs."""
    from tidelog.plans import catalogue

    rows = [(i, random.Random(i).choice(["a", "bc", "\u00e9"]) * i) for i in range(0, 3000, 13)] + [(3001, None), (3002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["codec_round_trip"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Scan parquet") == 1
    assert sorted(map(tuple, got.collect())) == sorted((c, len(rows), len(rows)) for c in X.CODECS)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert catalogue.QUERIES["codec_round_trip"](spark, str(tmp_path / "none")).count() == 0
