"""A store: a directory of operation-log parquet, one batch a write. The log is the write-ahead log and the data; files once written never change."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.resolve import resolve
from ..operators.retention import clip, cut_out
from ..schema import DELETE, DELETE_RANGE, ENTITY, MERGE, OP_LOG, PUT, SINGLE_DELETE, TIMED_PUT
from ..tables import numbered, written


@dataclass
class Batch:
    """Operations that are written together; savepoints cut the list back."""

    ops: list[tuple] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)

    def _add(self, op, key, value=None, columns=None, end=None, time=None, cf="default", udt=None) -> Batch:
        self.ops.append((cf, key, udt, len(self.ops), op, value, columns, end, time))
        return self

    def put(self, key, value, **how) -> Batch:
        return self._add(PUT, key, value, **how)

    def put_entity(self, key, columns: dict, **how) -> Batch:
        return self._add(ENTITY, key, columns=dict(sorted(columns.items())), **how)

    def put_groups(self, key, groups: dict[str, dict]) -> Batch:
        for cf, columns in groups.items():
            self.put_entity(key, columns, cf=cf)
        return self

    def timed_put(self, key, value, time: int, **how) -> Batch:
        return self._add(TIMED_PUT, key, value, time=time, **how)

    def delete(self, key, **how) -> Batch:
        return self._add(DELETE, key, **how)

    def single_delete(self, key, **how) -> Batch:
        return self._add(SINGLE_DELETE, key, **how)

    def delete_range(self, begin, end, **how) -> Batch:
        if end < begin:
            raise ValueError("the range ends before it begins")
        return self._add(DELETE_RANGE, begin, end=end, **how)

    def merge(self, key, value, **how) -> Batch:
        return self._add(MERGE, key, value, **how)

    def each(self, handler: object) -> None:
        """Calls the handler's method of each operation's name in lower case, in order, with its fields by name; an operation it has no method for is left out."""
        for cf, key, udt, _, op, value, columns, end, time in self.ops:
            method = getattr(handler, op.lower(), None)
            if method:
                method(cf=cf, key=key, udt=udt, value=value, columns=columns, end=end, time=time)

    def set_savepoint(self) -> None:
        self.marks.append(len(self.ops))

    def rollback(self) -> None:
        if not self.marks:
            raise LookupError("no savepoint")
        del self.ops[self.marks.pop() :]

    def pop_savepoint(self) -> None:
        if not self.marks:
            raise LookupError("no savepoint")
        self.marks.pop()


class Store:
    """One writer, which looks up the last sequence number when it first writes and keeps count from there; any number of readers.
    dedup=True refuses merge operands, strict=False lets them in."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, dedup: bool = False, strict: bool = True):
        self.spark, self.path, self.read_only, self.dedup, self.strict = spark, path.rstrip("/"), read_only, dedup, strict
        self._last: int | None = None

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(OP_LOG).parquet(f"{self.path}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], OP_LOG)
            raise

    def latest_seq(self) -> int:
        return self.log().agg(F.max("seq")).first()[0] or 0

    def newest_timestamp(self) -> int | None:
        return self.log().agg(F.max("udt")).first()[0]

    def families(self) -> list[str]:
        return sorted(r["cf"] for r in self.log().select("cf").distinct().collect())

    def _append(self, rows: DataFrame, last: int | None = None) -> None:
        """Appends log rows; `last` is the highest sequence number among them where the caller knows it."""
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        rows.select([F.col(f.name).cast(f.dataType) for f in OP_LOG]).write.mode("append").parquet(f"{self.path}/log")
        self._last = None if last is None else max(last, self._last or 0)

    def _base(self) -> int:
        if self._last is None:
            self._last = self.latest_seq()
        return self._last

    def write(self, batch: Batch) -> int:
        """Appends the batch with consecutive sequence numbers; returns the last."""
        if self.dedup and self.strict and any(op[4] == MERGE for op in batch.ops):
            raise NotImplementedError("merge operands can't go to a deduplicated store")
        base = self._base()
        rows = [(cf, key, udt, base + 1 + i, op, value, columns, end, time, base + 1) for i, (cf, key, udt, _, op, value, columns, end, time) in enumerate(batch.ops)]
        if rows:
            self._append(self.spark.createDataFrame(rows, OP_LOG), base + len(rows))
        return base + len(rows)

    def ingest(self, rows: DataFrame, behind: bool = False, cf: str = "default") -> int:
        """Adds a table (user_key, value) of distinct keys under one sequence number: above all others, or below all (behind)."""
        if rows.groupBy("user_key").count().filter("count > 1").head(1):
            raise ValueError("keys to be ingested must be distinct")
        seq = 0 if behind else self._base() + 1
        null = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
        known = {"cf": F.lit(cf), "user_key": F.col("user_key"), "seq": F.lit(seq), "op": F.lit(PUT), "value": F.col("value"), "batch_id": F.lit(seq)}
        self._append(rows.select(*[known[f.name].cast(f.dataType).alias(f.name) if f.name in known else null(f) for f in OP_LOG]), seq)
        return seq

    def bulk(self, rows: DataFrame, order: str) -> int:
        """Appends a table of operations (op, user_key, value, ...) numbered in the order of a column; equal values in any order. Returns the last number.

        The table is ranged by the column and written once with each row's part and place in it; numbers follow from the parts' counts. So no task sees
        all rows, and what a part holds can't change between counting and numbering."""
        base = self._base()
        placed = numbered(rows, order).withColumn("seq", F.col("number") + base).withColumn("batch_id", F.lit(base + 1))
        for f in OP_LOG:
            if f.name not in placed.columns:
                placed = placed.withColumn(f.name, F.lit("default" if f.name == "cf" else None).cast(f.dataType))
        last = base + placed.count()
        self._append(placed, last)
        return last

    def state(self, snapshot: int | None = None, **how) -> DataFrame:
        return resolve(self.log(), snapshot, **how)

    def updates_since(self, seq: int) -> DataFrame:
        return self.log().filter(F.col("seq") >= seq).orderBy("seq")

    def checkpoint(self, to: str, snapshot: int | None = None, **how) -> None:
        """The resolved state as a table, sorted by key within files."""
        self.state(snapshot, **how).sortWithinPartitions("cf", "user_key").write.parquet(to)

    def compact(self, to: str, **how) -> Store:
        """A new store whose log holds only what the state needs."""
        fresh = Store(self.spark, to)
        state = self.state(**how)
        rows = state.withColumn("op", F.when(F.col("columns").isNotNull(), ENTITY).otherwise(PUT) if "columns" in state.columns else F.lit(PUT))
        for f in OP_LOG:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        fresh._append(rows.sortWithinPartitions("cf", "user_key"))
        return fresh

    def backup(self, to: str) -> dict:
        """A copy with a manifest of row count, last sequence number and a checksum of all rows; verify() holds a copy against it."""
        log = self.log()
        log.write.parquet(f"{to}/log")
        manifest = _fingerprint(log)
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{to}/manifest")
        return manifest

    def restore(self, to: str) -> Store:
        """A store with a backup's log, which is verified first."""
        if not self.verify():
            raise ValueError("the backup is not what its manifest says")
        out = Store(self.spark, to)
        out._append(self.log())
        return out

    def repair(self, to: str) -> Store:
        """A store of every entry that can be read, once each, with the batch and sequence numbers they have; a manifest is made anew."""
        out = Store(self.spark, to)
        rows = self.spark.read.schema(OP_LOG).option("ignoreCorruptFiles", True).parquet(f"{self.path}/log").filter("seq is not null and user_key is not null")
        plain = [F.to_json("columns") if f.name == "columns" else F.col(f.name) for f in OP_LOG]
        out._append(rows.withColumn("__cells", F.xxhash64(*plain)).dropDuplicates(["cf", "user_key", "seq", "__cells"]).drop("__cells"))
        return out

    def undump(self, path: str, fmt: str = "json") -> int:
        """Appends what dump() wrote, numbered in the order of the dumped sequence numbers; returns the last number."""
        rows = self.spark.read.schema("cf string, user_key string, value string, seq long, columns map<string,string>").format(fmt).load(path)
        kind = F.when(F.col("columns").isNotNull(), ENTITY).otherwise(PUT)
        return self.bulk(rows.select("cf", "user_key", "value", "columns", F.col("seq").alias("was"), kind.alias("op")), "was")

    def replay(self, rows: DataFrame) -> DataFrame:
        """(user_key, same) after all rows (user_key, value) were put in order of `at`: whether a read gives each key the last value it was given."""
        self.bulk(rows.select("at", "user_key", "value", F.lit(PUT).alias("op")), "at")
        want = rows.groupBy("user_key").agg(F.max_by("value", "at").alias("want"))
        return want.join(self.state().select("user_key", "value"), "user_key", "left").select("user_key", F.col("value").eqNullSafe(F.col("want")).alias("same"))

    def verify(self) -> bool:
        want = json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])
        return _fingerprint(self.log()) == want

    def drop_range(self, lo: str, hi: str, to: str) -> Store:
        """A store without what this one says of keys in [lo, hi)."""
        out = Store(self.spark, to)
        out._append(cut_out(self.log(), lo, hi))
        return out

    def clip(self, lo: str, hi: str, to: str) -> Store:
        """A store of keys in [lo, hi) alone."""
        out = Store(self.spark, to)
        out._append(clip(self.log(), lo, hi))
        return out

    def drop_family(self, cf: str, to: str) -> Store:
        out = Store(self.spark, to)
        out._append(self.log().filter(F.col("cf") != cf))
        return out

    def import_family(self, path: str, cf: str) -> int:
        return self.ingest(self.spark.read.parquet(path).select("user_key", "value"), cf=cf)

    def dump(self, to: str, fmt: str = "json", **how) -> None:
        state = self.state(**how)
        (state if fmt == "json" else state.select("cf", "user_key", "value", "seq")).write.format(fmt).save(to)

    def files(self) -> DataFrame:
        """Per data file: rows, key range, sequence range, size."""
        meta = self.spark.read.schema(OP_LOG).parquet(f"{self.path}/log").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return meta.groupBy("file").agg(F.count("*").alias("n"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("bytes").alias("bytes"))


def _fingerprint(log: DataFrame) -> dict:
    cells = [F.to_json(F.col(f.name)) if f.name == "columns" else F.col(f.name).cast("string") for f in OP_LOG]
    n, seq, total = log.agg(F.count("*"), F.max("seq"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)"))).first()
    return {"rows": n, "last_seq": seq, "checksum": str(total)}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(user_key, value) of lines key<TAB>value: the first tab splits, lines without one are skipped."""
    lines = spark.read.text(path)
    tab = F.instr("value", "\t")
    return lines.filter(tab > 0).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("user_key"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))


def workload(spark: SparkSession, records: int, operations: int, mix: tuple[int, int, int, int] = (50, 30, 10, 10), value_bytes: int = 100, fills: int = 16, seed: int = 7) -> DataFrame:
    """(ts, op, user_key, value, scan_length): a load of `records` inserts, then read / update / insert / scan operations in the given percentages."""
    key = lambda n: F.format_string("user%020d", n)
    fill = lambda n: F.repeat(F.expr(f"char(97 + cast(pmod(xxhash64({n}, {seed}), {fills}) as int))"), value_bytes)
    load = spark.range(records).select(F.col("id").alias("ts"), F.lit("insert").alias("op"), key(F.col("id")).alias("user_key"), fill("id").alias("value"), F.lit(None).cast("int").alias("scan_length"))
    pick = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(100))
    read, update, insert, _ = mix
    op = F.when(pick < read, "read").when(pick < read + update, "update").when(pick < read + update + insert, "insert").otherwise("scan")
    target = F.when(op == "insert", F.col("id") + records).otherwise(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(max(records, 1))))
    run = spark.range(operations).select((F.col("id") + records).alias("ts"), op.alias("op"), key(target).alias("user_key"), F.when(op.isin("update", "insert"), fill("id")).alias("value"), F.when(op == "scan", 50).alias("scan_length"))
    return load.unionByName(run)
