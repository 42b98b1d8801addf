import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import jpeg, media, sharding

from .conftest import CASES


def naive_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [naive_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_shard(F.lit(1), 0)


def test_shards(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("place")).repartition(7)
    rows = sharding.shard(df, 16, bucket_rows=20).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 450
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and any(r["grown_shard"] == 16 for r in rows)
    assert {(r["size"], r["text_crc32"], r["law"]) for r in rows} == {(3, zlib.crc32("é".encode()), "key")}
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(df.repartition(2), 16).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}


def test_shards_do_not_depend_on_the_width_of_the_key(spark):
    at = lambda kind: {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(spark.range(100).select(F.col("id").cast(kind).alias("doc_id"), F.lit("t").alias("text"))).collect()}
    assert at("int") == at("long") == at("tinyint")


def test_shard_edge_cases(edge, none):
    rows = sharding.shard(edge).collect()
    assert len(rows) == len(CASES) and len({r["shard"] for r in rows if r["doc_id"] == 2}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (7, 8)} == {(1, 0)}
    assert sharding.shard(none).count() == 0


PAYLOADS = [bytes(64), bytes(range(64)), bytes(range(256)) * 3, bytes([0] * 63 + [255]) * 7, random.Random(1).randbytes(64 * 50), bytes([1, 2] + [0] * 30 + [255] + [0] * 31) * 13, b"\xff" * 384]


def test_files_round_trip():
    files = jpeg.encode(PAYLOADS)
    for own in ([PAYLOADS, files], *[[[p], [f]] for p, f in zip(PAYLOADS, files, strict=True)]):
        pics, blocks = jpeg.coefficients(own[1])
        for p, got in zip(own[0], jpeg.payloads(pics, blocks), strict=True):
            assert got[: len(p)] == p and not any(got[len(p) :])
    assert jpeg.encode(PAYLOADS[2:3]) == files[2:3]
    for f in files:
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and f.count(b"\xff\xda") >= 11


def slow_scans(raw):
    """Coefficients of one file by a plain bit-by-bit decoder of the same scans."""
    pic, out, total = jpeg.parse(raw), [], 0
    for c in pic.comps:
        c.base, total = total, total + c.stride * c.rows
    out = np.zeros((total, 64), int)
    for s in pic.scans:
        codes = []
        for table in s.tables:
            code, at, found = 0, 16, {}
            for n in range(1, 17) if table else ():
                for _ in range(table[n - 1]):
                    found[n, code] = table[at]
                    code, at = code + 1, at + 1
                code <<= 1
            codes.append(found)
        parts, cur, i = [], bytearray(), 0
        while i < len(s.data):
            if s.data[i] == 255 and 0xD0 <= s.data[i + 1] <= 0xD7:
                parts.append(bytes(cur))
                cur, i = bytearray(), i + 2
            else:
                cur.append(s.data[i])
                i += 1 + (s.data[i] == 255)
        parts.append(bytes(cur))
        unit = 0
        for part in parts:
            bits = iter("".join(f"{b:08b}" for b in part))
            take = lambda n: int("".join(next(bits) for _ in range(n)) or "0", 2)  # noqa: B023, E731
            signed = lambda n: (lambda v: v if not n or v >= 1 << n - 1 else v - (1 << n) + 1)(take(n))  # noqa: B023, E731

            def symbol(found):
                code = 0
                for n in range(1, 17):
                    code = code << 1 | take(1)  # noqa: B023
                    if (n, code) in found:
                        return found[n, code]
                raise ValueError

            if s.ss == 0:
                pred = [0, 0, 0]
                across = pic.mcus[0]
                for j, c in enumerate(s.comps):
                    comp = pic.comps[c]
                    for y in range(comp.v):
                        for x in range(comp.h):
                            at = comp.base + (unit // across * comp.v + y) * comp.stride + unit % across * comp.h + x
                            if s.ah:
                                out[at, 0] |= take(1) << s.al
                            else:
                                pred[j] += signed(symbol(codes[j]))
                                out[at, 0] = pred[j] << s.al
            else:
                row, k = out[pic.comps[s.comps[0]].base + unit], s.ss
                fix = lambda k: take(1) and row.__setitem__(k, row[k] + (1 if row[k] > 0 else -1))  # noqa: B023, E731
                while k <= s.se:
                    v = symbol(codes[0])
                    r, n = v >> 4, v & 15
                    if not s.ah:
                        if n == 0 and r < 15:
                            break
                        k += r
                        if n:
                            row[k] = signed(n) << s.al if n else 0
                        k += 1
                        continue
                    new = (1 if take(1) else -1) if n else 0
                    end = n == 0 and r < 15
                    while k <= s.se:
                        if row[k]:
                            fix(k)
                        elif not end:
                            if r == 0:
                                row[k] = new
                                k += 1
                                break
                            r -= 1
                        k += 1
                    if end:
                        break
            unit += 1
    return out


def test_decoder_equals_a_bitwise_one():
    for f in jpeg.encode(PAYLOADS):
        assert (jpeg.coefficients([f])[1] == slow_scans(f)).all()


def test_inverse_equals_the_definition():
    rng = np.random.default_rng(2)
    z = rng.integers(-200, 200, (5, 64))
    natural = np.zeros((5, 64))
    natural[:, jpeg.ZIGZAG] = z
    c = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    want = np.einsum("ux,nuv,vy->nxy", c, natural.reshape(5, 8, 8), c)
    assert np.abs(jpeg.inverse(z.astype(float)) - want).max() < 0.6


def test_known_color():
    """A flat gray file, and one whose chroma says red."""
    gray = jpeg.encode([bytes(384)])[0]
    assert (jpeg.tensors(*jpeg.coefficients([gray]))[0] == 128).all()
    red = bytearray(384)
    red[5 * 64] = 100  # the first coefficient of Cr: 100 / 8 above the middle
    rgb = jpeg.tensors(*jpeg.coefficients(jpeg.encode([bytes(red)])))[0]
    assert rgb.shape == (16, 16, 3) and (rgb[:, :, 0] > 140).all() and (rgb[:, :, 1] < 128).all() and (rgb[:, :, 2] == 128).all()


def test_media(edge, none):
    rows = media.read(media.store(edge), keep=True).collect()
    by = {}
    for k, t in CASES:
        by.setdefault(k, []).append((t or "").encode())
    assert len(rows) == len(CASES)
    for r in rows:
        raw = next(b for b in by[r["doc_id"]] if len(b) == r["n_bytes"] and bytes(r["payload"]).startswith(b))
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(r["payload"]) == body and r["payload_bytes"] == len(body) and r["payload_sha256"] == hashlib.sha256(body).hexdigest() and r["tail_crc32"] == zlib.crc32(body[-64:])
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (3, 5)}
    assert len(same) == 1
    assert media.read(media.store(none)).count() == 0


def test_media_columns_are_stored_and_read_back(spark, edge, tmp_path):
    media.store(edge).write.parquet(str(tmp_path / "media"))
    files = spark.read.parquet(str(tmp_path / "media"))
    media.read(files, keep=True).write.parquet(str(tmp_path / "rgb"))
    want = {r["doc_id"]: r for r in media.read(media.store(edge.filter("doc_id <> 2"))).collect()}
    for r in spark.read.parquet(str(tmp_path / "rgb")).filter("doc_id <> 2").collect():
        tensor = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert media.feature(tensor) == r["feature"] == want[r["doc_id"]]["feature"]
        assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_sha256"] == want[r["doc_id"]]["payload_sha256"]
