"""python -m tidelog.cli --store PATH COMMAND: put, delete, delete_range, merge, batch_put, get, multi_get, scan, dump, load, compact, backup, verify, families, properties, files, count, wal."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import scan as scans
from .sources.store import Batch, Store, read_tsv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--merge", default=None, help="name of the merge operator")
    p.add_argument("--snapshot", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "put": ("key", "value"), "merge": ("key", "value"), "delete": ("key",), "delete_range": ("begin", "end"), "get": ("key",), "load": ("file",),
        "compact": ("to",), "backup": ("to",), "dump": ("to",), "verify": (), "families": (), "properties": (), "files": (), "count": (),
    }.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    s = sub.add_parser("batch_put")
    s.add_argument("pairs", nargs="+", help="key value key value ...")
    s = sub.add_parser("multi_get")
    s.add_argument("keys", nargs="+")
    s = sub.add_parser("scan")
    for a in ("--from", "--to", "--prefix"):
        s.add_argument(a, dest=a.strip("-") + "_")
    s.add_argument("--max-keys", type=int, default=100)
    s.add_argument("--reverse", action="store_true")
    s = sub.add_parser("wal")
    s.add_argument("--since", type=int, default=0)
    s.add_argument("--max", type=int, default=100)
    return p


def run(spark: SparkSession, argv: list[str]) -> list[dict]:
    """The rows a command prints."""
    a = parser().parse_args(argv)
    store, c = Store(spark, a.store), a.command
    state = lambda: store.state(a.snapshot, merge=a.merge).select("cf", "user_key", "value", "seq")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if c in ("put", "merge"):
        return [{"seq": store.write(getattr(Batch(), c)(a.key, a.value))}]
    if c == "delete":
        return [{"seq": store.write(Batch().delete(a.key))}]
    if c == "delete_range":
        return [{"seq": store.write(Batch().delete_range(a.begin, a.end))}]
    if c == "batch_put":
        batch = Batch()
        for k, v in zip(a.pairs[::2], a.pairs[1::2], strict=True):
            batch.put(k, v)
        return [{"seq": store.write(batch)}]
    if c == "get":
        return rows(store.state(a.snapshot, merge=a.merge, key_pred=F.col("user_key") == a.key).select("cf", "user_key", "value", "seq"))
    if c == "multi_get":
        keys = spark.createDataFrame(list(enumerate(a.keys)), "pos int, user_key string")
        return rows(scans.multi_get(state(), keys).orderBy("pos"))
    if c == "scan":
        return rows(scans.scan(state(), a.from_, a.to_, a.prefix_, a.reverse, a.max_keys))
    if c == "load":
        return [{"seq": store.ingest(read_tsv(spark, a.file))}]
    if c == "compact":
        return [{"seq": store.compact(a.to, merge=a.merge).latest_seq()}]
    if c == "backup":
        return [store.backup(a.to)]
    if c == "dump":
        store.dump(a.to, merge=a.merge)
        return []
    if c == "verify":
        return [{"ok": store.verify()}]
    if c == "families":
        return [{"cf": x} for x in store.families()]
    if c == "properties":
        return rows(scans.properties(store.log()))
    if c == "files":
        return rows(store.files())
    if c == "count":
        return [{"n": state().count()}]
    return rows(store.updates_since(a.since).limit(a.max))


def main() -> None:
    spark = SparkSession.builder.appName("tidelog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for row in run(spark, sys.argv[1:]):
        print(json.dumps(row, default=str))


if __name__ == "__main__":
    main()
