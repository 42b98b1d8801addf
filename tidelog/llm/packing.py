"""Best-fit packing of documents into sequences under three capacities: tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import byte_chunks, durable, give_back, texts_of

#: Remainders that one task packs; bins never cross groups, which costs at most one part-filled bin or so in each.
GROUP = 16_384
#: Documents in a sequence, and attention cost as a share of the square of its tokens, that pack_documents() allows. Both bind: on 51,282 documents the best fit under tokens
#: alone had 122 documents in one sequence and costs up to 1, and these capacities take 0.1 % more sequences.
DOCUMENTS, ATTENTION = 64, 0.98


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> np.ndarray:
    """The bin of each item. An item takes `length` tokens, one document and length**2 of attention cost.

    Longest items first. Of the open bins with room in all three, 'norm' takes the one whose weighted residual is
    smallest after placing, 'dot' the one whose residual has the largest weighted dot product with the item's demand; ties: the oldest. Without
    room anywhere a bin is opened. An item beyond a capacity by itself gets a bin of its own.
    """
    caps = np.array([capacity, max_docs, max_cost], float)
    w = np.asarray(weights) / caps**2
    place = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    left, ids = np.empty((3, 1024)), np.empty(1024, np.int64)
    n = bins = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        need = (size, 1.0, float(size) * size)
        a, b, c = left[0, :n], left[1, :n], left[2, :n]
        fits = np.flatnonzero((a >= size) & (b >= 1) & (c >= need[2]))
        if len(fits):
            a, b, c = a[fits], b[fits], c[fits]
            if rule == "norm":
                k = fits[np.argmin(w[0] * (a - size) ** 2 + w[1] * (b - 1) ** 2 + w[2] * (c - need[2]) ** 2)]
            else:
                k = fits[np.argmax(w[0] * size * a + w[1] * b + w[2] * need[2] * c)]
        else:
            if n == left.shape[1]:
                keep = np.flatnonzero((left[0, :n] > 0) & (left[1, :n] >= 1))
                left[:, : len(keep)], ids[: len(keep)], n = left[:, keep], ids[keep], len(keep)
                if n > left.shape[1] // 2:
                    left, ids = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([ids, np.empty_like(ids)])
            k, n = n, n + 1
            left[:, k], ids[k], bins = caps, bins, bins + 1
        left[:, k] -= need
        place[i] = ids[k]
    return place


def pieces(docs: DataFrame, vocabulary: dict, capacity: int = 2048, end: int = 0, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of each text and the id `end`, cut into pieces of `capacity`
    ids where longer; then only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = tokens.encoder(**vocabulary).encode, np.array([end], "<u4").tobytes()
        for batch in byte_chunks(batches):
            keys, rows, bodies = batch.column("key").to_pylist(), [], []
            for k, body in zip(keys, texts_of(batch), strict=True):
                ids = encode(body) + tail
                at, n = 0, len(ids) // 4
                stop = n % capacity or capacity
                piece = 0
                while at < n:
                    part = ids[4 * at : 4 * stop]
                    rows.append((k, piece, at, stop - at, zlib.crc32(part)))
                    if keep_ids:
                        bodies.append(np.frombuffer(part, "<u4").astype("i4"))
                    at, stop, piece = stop, stop + capacity, piece + 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(bodies, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    )


def pack(parts: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length`; other columns stay (an old sequence_id or offset goes). Full pieces are sequences by themselves.

    Rows are dealt to groups of about `group` by a hash of their place in the input, so equal keys spread like others. By default
    the document and cost capacities are those that `capacity` tokens can never exceed. Empty input: empty result.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or float(capacity) ** 2
    parts = durable(parts.drop("sequence_id", "offset").withColumn("__place", F.monotonically_increasing_id()), "pieces")
    alone = (F.col("length") >= capacity) | (F.lit(2.0) * F.col("length") * F.col("length") > 2 * max_cost)
    full = parts.filter(alone).withColumn("sequence_id", -1 - F.col("__place")).withColumn("offset", F.lit(0).cast("long")).drop("__place")
    rest = parts.filter(~alone)
    groups = max(1, -(-rest.count() // group))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__place", kind="stable")
        bins = best_fit(frame["length"].to_numpy(), capacity, max_docs, max_cost, rule)
        out = frame[["__place"]].copy()
        out["sequence_id"] = int(frame["__group"].iloc[0]) * (1 << 24) + bins
        out["offset"] = (frame["length"].groupby(bins).cumsum() - frame["length"]).to_numpy()
        return out

    small = rest.select("__place", "length", F.pmod(F.xxhash64("__place"), F.lit(groups)).alias("__group"))
    placed = small.repartition(groups, "__group").groupBy("__group").applyInPandas(fit, "__place long, sequence_id long, offset long")
    return rest.join(placed, "__place").drop("__place").unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: dict, capacity: int = 2048, end: int = 0, keep_ids: bool = False, max_docs: int = DOCUMENTS, attention: float = ATTENTION, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document; a sequence has at most `capacity` tokens, max_docs
    pieces and attention * capacity**2 of the sum of squared lengths, but a piece that alone costs more, which is a sequence by itself.

    Null or empty text: one piece of the end id alone. Very long texts: pieces of `capacity`. Null or repeated keys: pieces each.
    """
    return pack(pieces(docs, vocabulary, capacity, end, keep_ids), capacity, max_docs, attention * capacity**2, **how)
