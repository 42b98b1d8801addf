"""Traces as text: lines `key-in-hex type cf_id value_size ts`, and a synthetic one as a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key binary, type int, cf_id int, value_size long, ts long"


def parse_lines(lines: DataFrame) -> DataFrame:
    """The trace of a frame of text lines (value); lines with another number of fields are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).filter(F.size("p") == 5)
    at = lambda i: F.col("p")[i]
    return rows.select(F.unhex(at(0)).alias("key"), at(1).cast("int").alias("type"), at(2).cast("int").alias("cf_id"), at(3).cast("long").alias("value_size"), at(4).cast("long").alias("ts"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Through Spark's text reader: any store Spark can read, any number of files."""
    return parse_lines(spark.read.text(path))


def write_trace(trace: DataFrame, path: str) -> None:
    key = F.hex(F.col("key").cast("binary")) if dict(trace.dtypes)["key"] in ("binary", "string") else F.hex("key")
    trace.select(F.concat_ws(" ", key, "type", "cf_id", "value_size", "ts").alias("value")).write.text(path)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts, self.keys = int(options.get("rows", 1000)), int(options.get("partitions", 4)), int(options.get("keys", 100))

    def partitions(self) -> list[InputPartition]:
        cuts = [self.rows * i // self.parts for i in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(partition.start, partition.stop):
            x = (i * 2654435761 + 12345) % 2**32
            yield (x % self.keys).to_bytes(8, "big"), x // 7 % 10, x // 3 % 4, x // 11 % 300, i * 1000


class SyntheticTrace(DataSource):
    """spark.dataSource.register(SyntheticTrace); spark.read.format("synthetic_trace").option("rows", n).load() - and a pattern for sources of your own."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_trace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
