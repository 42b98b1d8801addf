"""Token counts of flat, unindexed token files by a search for end-of-document ids.

A flat file is a run of fixed-width ids, documents one after another, each closed by the separator id; nothing says where
a document begins. Files are read as blocks of (stream, block, data). Each block is searched on its own with numpy; a two-level
prefix scan over the blocks' summaries (never the tokens) then finds the documents that cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import byte_chunks, durable, texts_of

EOD = 50256
#: What write_flat() closes documents with: a text that spells out <|endoftext|> encodes to EOD, but none to this.
SEPARATOR = 65535
BLOCK_TOKENS = 1 << 16
#: Blocks whose summaries one task of the prefix scan sorts.
SPAN = 1024


def write_flat(docs: DataFrame, vocabulary: dict, eod: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (kind, stream, at, data, ids): kind 'block' holds a block of a flat token stream, kind 'order' the keys of the
    documents in the order written. One stream for each task; the separator stands after every document, empty ones too. An id of a text that
    is the separator or doesn't fit the width is an error."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(**vocabulary).encode
        stream, block, done = TaskContext.get().partitionId(), 0, 0
        end, held, size, most = np.array([eod], dtype).tobytes(), [], 0, block_tokens * width
        schema = pa.schema([("kind", pa.string()), ("stream", pa.int32()), ("at", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])
        out = lambda kind, at, data, ids: pa.RecordBatch.from_pylist([{"kind": kind, "stream": stream, "at": at, "data": data, "ids": ids}], schema)
        for batch in byte_chunks(batches):
            for body in texts_of(batch):
                ids = np.frombuffer(encode(body), "<u4")
                if len(ids) and (ids.max() > np.iinfo(dtype).max or (ids == eod).any()):
                    raise ValueError(f"a text encodes to the separator {eod} or to an id beyond {dtype}")
                ids = ids.astype(dtype).tobytes() + end
                held.append(ids)
                size += len(ids)
                while size >= most:
                    whole = b"".join(held)
                    yield out("block", block, whole[:most], None)
                    block, held, size = block + 1, [whole[most:]], size - most
            yield out("order", done, None, batch.column("key").to_pylist())
            done += batch.num_rows
        if size:
            yield out("block", block, b"".join(held), None)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "kind string, stream int, at long, data binary, ids array<bigint>")


def read_flat(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(stream, block, data) of raw flat token files under path, through Spark's binary reader (files of up to 2 GB, its limit)."""
    most = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    block = F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / most).cast("int"))).alias("block")
    return files.select(F.col("path").alias("stream"), block, "content").select("stream", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {most} + 1, {most})").alias("data"))


def _scan_block(data: bytes, dtype: str, eod: int) -> tuple[int, int, int | None, int | None, list[int], list[int]]:
    ids = np.frombuffer(data, dtype)
    ends = np.flatnonzero(ids == eod)
    if not len(ends):
        return len(ids), 0, None, None, [], []
    return len(ids), len(ends), int(ends[0]), int(ends[-1]), (ends[:-1] + 1).tolist(), (np.diff(ends) - 1).tolist()


def _before(df: DataFrame, value: str, how, name: str) -> DataFrame:
    """Adds how(value) over the earlier blocks of the stream: within a span of blocks, then over the spans before it."""
    earlier = lambda *by: Window.partitionBy(*by)
    past = (Window.unboundedPreceding, -1)
    spans = df.groupBy("stream", "span").agg(how(value).alias("v"))
    spans = spans.select("stream", "span", how("v").over(earlier("stream").orderBy("span").rowsBetween(*past)).alias("outer"))
    df = df.withColumn("inner_", how(value).over(earlier("stream", "span").orderBy("block").rowsBetween(*past)))
    return df.join(spans, ["stream", "span"]).withColumn(name, how_two(how, F.col("outer"), F.col("inner_"))).drop("outer", "inner_")


def how_two(how, a, b):
    return F.greatest(a, b) if how is F.max else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def scan_blocks(blocks: DataFrame, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """(stream, ordinal, start, n_tokens, closed) for each document of the flat streams.

    n_tokens leaves the separator out; start is the place of the document's first token in its stream. Tokens after the
    last separator make a last document with closed = false. Two separators in a row: a document of no tokens. Empty
    blocks or no blocks: no documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scan_block(x or b"", dtype, eod) for x in batch.column("data").to_pylist()]
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("stream"), batch.column("block"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])],
                names=["stream", "block", "n", "n_ends", "first_end", "last_end", "starts", "lengths"],
            )

    kind = dict(blocks.dtypes)["stream"]
    seen = blocks.select("stream", F.col("block").cast("long").alias("block"), "data").mapInArrow(
        run, f"stream {kind}, block long, n long, n_ends long, first_end long, last_end long, starts array<bigint>, lengths array<bigint>"
    )
    seen = durable(seen, "token-blocks").withColumn("span", F.expr(f"block div {SPAN}"))
    seen = _before(_before(seen, "n", F.sum, "base"), "n_ends", F.sum, "ends_before")
    seen = _before(seen.withColumn("last_abs", F.col("base") + F.col("last_end")), "last_abs", F.max, "end_before")
    start = F.coalesce(F.col("end_before"), F.lit(-1)) + 1
    first = F.col("base") + F.col("first_end") - start
    rest = F.zip_with("starts", "lengths", lambda s, n: F.struct((F.col("base") + s).alias("start"), n.alias("n_tokens")))
    own = F.when(F.col("n_ends") > 0, F.concat(F.array(F.struct(start.alias("start"), first.alias("n_tokens"))), rest))
    closed = seen.select("stream", "ends_before", F.posexplode(own).alias("i", "d")).select("stream", (F.col("ends_before") + F.col("i")).alias("ordinal"), "d.start", "d.n_tokens", F.lit(True).alias("closed"))
    whole = seen.groupBy("stream").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max("last_abs"), F.lit(-1)) + 1).alias("start"))
    rest = whole.filter("n > start").select("stream", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, vocabulary: dict, eod: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """(doc_id, stream, ordinal, start, n_tokens) of each row of docs, counted from the flat streams that write_flat() makes of it.

    Null text: no tokens. Null or repeated keys: a row each. Empty table: empty result."""
    flat = durable(write_flat(docs, vocabulary, eod, dtype), "flat-tokens")
    counts = scan_blocks(flat.filter("kind = 'block'").select("stream", F.col("at").alias("block"), "data"), eod, dtype)
    order = flat.filter("kind = 'order'").select("stream", "at", F.posexplode("ids").alias("i", "doc_id"))
    order = order.select("stream", (F.col("at") + F.col("i")).alias("ordinal"), "doc_id")
    return order.join(counts, ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")
