"""Scalar expressions: prefixes, fixed-width and variable-width integers, counters, distances. All stay in the JVM but crc32c() and the codecs."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_prefix(key: Column, n: int) -> Column:
    """The first n characters or bytes; null for shorter keys, which are outside the extractor's domain."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped_prefix(key: Column, n: int) -> Column:
    return F.substring(key, 1, n)


def segments(key: Column, *widths: int) -> list[Column]:
    """Capped segments of the given widths, one after another; empty beyond the key's end."""
    out, at = [], 1
    for w in widths:
        out.append(F.substring(key, at, w))
        at += w
    return out


def counter(value: Column) -> Column:
    """An unsigned little-endian 64-bit counter as decimal(20,0); a value of another width counts as 0."""
    digits = F.hex(value)
    swapped = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    number = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(value) == 8, number).otherwise(F.lit(0).cast("decimal(20,0)"))


def counter_bytes(number: Column) -> Column:
    """The 8 little-endian bytes of number modulo 2**64."""
    digits = F.lpad(F.conv(wrap64(number).cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def wrap64(number: Column) -> Column:
    return number % F.lit(str(1 << 64)).cast("decimal(20,0)")


def big_endian(number: Column, width: int = 8) -> Column:
    """Order-preserving bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def from_big_endian(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("long")


def zigzag(number: Column) -> Column:
    return F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, 63))


def from_zigzag(number: Column) -> Column:
    return F.shiftrightunsigned(number, 1).bitwiseXOR(-number.bitwiseAND(F.lit(1)))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, summed from the first dimension to the last."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def difference_offset(a: Column, b: Column) -> Column:
    """The first place, from 0, where two strings differ; the shorter one's length where it is a prefix of the other."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.coalesce(F.get(places, 0) - 1, n)


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC32C = _crc32c_table()


def crc32c_of(raw: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in raw:
        crc = crc >> 8 ^ _CRC32C[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> list[int]:
    """CRCs of many values at once: each step takes one byte of every value that is long enough, longest first."""
    import numpy as np

    table = np.array(_CRC32C, np.uint32)
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data, starts = np.frombuffer(b"".join(values[i] for i in order), np.uint8), np.cumsum(sizes[order]) - sizes[order]
    crc, live = np.full(len(values), 0xFFFFFFFF, np.uint32), len(values)
    for at in range(int(sizes.max(initial=0))):
        while live and sizes[order[live - 1]] <= at:
            live -= 1
        crc[:live] = crc[:live] >> np.uint32(8) ^ table[(crc[:live] ^ data[starts[:live] + at]) & np.uint32(255)]
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out.tolist()


#: What stored checksums are rotated and shifted by; a fixed value.
MASK = 0xA282EAD8


def masked(crc: Column) -> Column:
    """A CRC as it is stored beside data that may itself hold CRCs."""
    rotated = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc.bitwiseAND(F.lit((1 << 15) - 1)), 17))
    return (rotated + MASK) % (1 << 32)


def unmasked(stored: Column) -> Column:
    rotated = F.pmod(stored - MASK, F.lit(1 << 32))
    return F.shiftrightunsigned(rotated, 17).bitwiseOR(F.shiftleft(rotated.bitwiseAND(F.lit((1 << 17) - 1)), 15))


def crc32c(raw: Column) -> Column:
    """Castagnoli CRC of a binary column; Spark's own crc32 has another polynomial."""

    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        some = [i for i, v in enumerate(x) if v is not None]
        out = pd.Series([None] * len(x), dtype="Int64")
        if some:
            out.iloc[some] = crc32c_many([bytes(x.iloc[i]) for i in some])
        return out

    return of(raw)


def varint(number: Column) -> Column:
    """The bytes of a non-negative integer, seven bits each from the lowest, all but the last with the top bit set; as hexadecimal digits."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.call_function("shiftrightunsigned", number, i * 7))
    used = F.filter(parts, lambda p, i: (i == 0) | (p > 0))
    return F.array_join(F.transform(used, lambda p: F.lpad(F.hex(F.when(p >= 128, p.bitwiseAND(F.lit(127).cast("long")) + 128).otherwise(p)), 2, "0")), "")


def packed_seq(seq: Column, kind: Column) -> Column:
    """The eight bytes that follow a key inside a file: sequence number and type in one long."""
    return F.shiftleft(seq, 8).bitwiseOR(kind.cast("long"))


def unpacked_seq(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 8), packed.bitwiseAND(F.lit(255).cast("long"))


CODECS = ("none", "zlib", "bzip2", "zstd", "snappy", "lz4")


@functools.cache
def _codec(name: str, forward: bool):
    import bz2
    import zlib

    import pyarrow as pa

    if name == "none":
        return bytes
    if name == "zlib":
        return zlib.compress if forward else zlib.decompress
    if name == "bzip2":
        return bz2.compress if forward else bz2.decompress
    if name not in CODECS:
        raise ValueError(f"no codec named {name!r}")
    codec = pa.Codec({"lz4": "lz4_raw"}.get(name, name))
    if forward:
        return lambda raw: len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)
    return lambda raw: codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _by_rows(raw: Column, codec: str, forward: bool) -> Column:
    """Row by row: values come and go a hundred at a time, where batches of Arrow hold ten thousand of whatever size, in every form they pass through."""
    _codec(codec, forward)

    def run(v: bytes | None) -> bytes | None:
        return None if v is None else _codec(codec, forward)(bytes(v))

    return F.udf(run, "binary", useArrow=False)(raw)


def compressed(raw: Column, codec: str) -> Column:
    return _by_rows(raw, codec, True)


def decompressed(raw: Column, codec: str) -> Column:
    return _by_rows(raw, codec, False)
