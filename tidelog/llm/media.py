"""Media columns: texts stored as progressive JPEG files, and files read back into payloads, RGB tensors and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import byte_chunks

BLOCK = 64
#: Bytes of payload or files that are coded together.
TOGETHER = 1 << 20


def payload_of(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of BLOCK."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a progressive JPEG file; the bytes are its coefficients, so nothing is lost.

    Null or empty text: one block of zeros. Repeated rows and null keys: a file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, most=TOGETHER):
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            files = jpeg.encode([payload_of(x) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(tensor: np.ndarray) -> str:
    """Height, width, the mean of each channel and the CRC-32 of the tensor."""
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) / (tensor.size // 3)
    return f"{tensor.shape[0]}x{tensor.shape[1]}:" + ",".join(f"{m:.4f}" for m in means) + f":{zlib.crc32(tensor):08x}"


def read(media: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, payload, height, width, rgb]) from what store() made.

    The payload is read from the file's coefficients (n_bytes says where the fill of the last rows begins); keep adds it and the full-resolution tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "media", TOGETHER):
            files, sizes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
            pics, blocks = jpeg.coefficients(files)
            rows = []
            for f, n, body, rgb in zip(files, sizes, jpeg.payloads(pics, blocks), jpeg.tensors(pics, blocks), strict=True):
                size = n + (-n % BLOCK if n else BLOCK)
                body = body[:size]
                row = [size, hashlib.sha256(body).hexdigest(), zlib.crc32(body[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature(rgb)]
                rows.append(row + [body, rgb.shape[0], rgb.shape[1], rgb.tobytes()] if keep else row)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], names=names)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds += ", payload binary, height int, width int, rgb binary" if keep else ""
    names = [x.split()[0] for x in kinds.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kinds)
