from pyspark.sql import functions as F

from tidelog import cli
from tidelog.sources import traces


def test_commands(spark, tmp_path):
    run = lambda *args: cli.run(spark, ["--store", str(tmp_path / "s"), *args])
    assert run("batch_put", "a", "1", "b", "2", "bb", "3") == [{"seq": 3}]
    assert run("delete", "a") == [{"seq": 4}]
    assert [r["user_key"] for r in run("scan", "--prefix", "b", "--reverse")] == ["bb", "b"]
    assert run("get", "b")[0]["value"] == "2" and run("get", "a") == []
    assert [r["found"] for r in run("multi_get", "b", "a", "b")] == [True, False, True]
    assert run("count") == [{"n": 2}] and run("families") == [{"cf": "default"}]
    assert len(run("wal", "--since", "3")) == 2 and run("properties")[0]["n_entries"] == 4
    (tmp_path / "t.tsv").write_text("x\ty\n")
    run("load", str(tmp_path / "t.tsv"))
    run("compact", str(tmp_path / "c"))
    run("backup", str(tmp_path / "k"))
    run("dump", str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 3
    assert cli.run(spark, ["--store", str(tmp_path / "k"), "verify"]) == [{"ok": True}]
    assert cli.run(spark, ["--store", str(tmp_path / "c"), "count"]) == [{"n": 3}]


def test_trace_text_round_trip(spark, tmp_path):
    spark.dataSource.register(traces.SyntheticTrace)
    t = spark.read.format("synthetic_trace").option("rows", 50).load()
    assert t.count() == 50
    traces.write_trace(t, str(tmp_path / "t"))
    again = traces.read_trace(spark, str(tmp_path / "t"))
    assert again.exceptAll(t).count() == 0 == t.exceptAll(again).count()
    assert traces.parse_lines(spark.createDataFrame([("a b",)], "value string")).count() == 0
    assert t.select(F.max("type")).first()[0] <= 9
