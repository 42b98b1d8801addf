"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

FOLDS = 5
#: Labelled rows taken of each class, and the longest text (bytes) that may be among them.
ROWS, BYTES = 4000, 32_768


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, longest: int = BYTES, by_class: bool = True, key: str = "doc_id", text: str = "text") -> tuple[list[str], list[int], dict[int, int]]:
    """(texts, labels, rows of each class in all) outside the held-out fold: the `rows` of each class (by_class) or of all whose key has the smallest hash, of
    documents of at most `longest` bytes.

    Keys and lengths are ranked; texts are read only of the chosen ones, a bounded number that goes to the documents by broadcast. Null labels and keys are left
    out; a key labelled twice counts with its larger label, a key of several documents with the text of the smallest hash."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    marks = marks.groupBy(F.col(key).cast("long").alias("chosen")).agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    fit = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") <= longest)
    marks = durable(marks.join(fit.select("id"), F.col("chosen") == F.col("id"), "left_semi"), "labelled")
    first = lambda df: df.orderBy(F.xxhash64("chosen", F.lit("sample")), "chosen").limit(rows)
    chosen = first(marks)
    if by_class:
        chosen = first(marks.filter("label = 1")).unionByName(first(marks.filter("label = 0")))
    got = fit.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
    got = sorted(got.toArrow().to_pylist(), key=lambda r: (hash_order(r["id"]), r["text"]))
    return [r["text"] for r in got], [r["label"] for r in got], totals


def hash_order(key: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(key), 7)
