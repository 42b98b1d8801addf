"""Exact substring dedup: each byte covered by a `width`-byte string that also starts in a document with a smaller id is removed.

1. Equal texts collapse to the one with the smallest id; a later copy of at least `width` bytes goes whole.
2. Every window of `width` bytes has a minimizer, the smallest hash of its GRAM-byte strings, so equal windows have equal ones. Windows in a row
   with the same minimizer form a segment. Minimizers that occur in one text only are found by an exact exchange of hashes
   (packed, one row for many) and their windows dropped: they repeat nowhere.
3. The other segments meet by minimizer. Equal segments collapse, first in each task, to one string with its smallest id. Strings that share a
   minimizer but differ are sorted by suffix_array.window_classes(), and a window goes if its class has a smaller id.
4. The removed windows of each document are joined to its text once and merged into spans.

Nothing here is sampled: a segment is dropped only where no equal window can exist. A string that very many documents share leaves
each task once, so it doesn't gather its documents in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, byte_chunks, durable, give_back
from .suffix_array import window_classes

WIDTH, GRAM = 50, 24
#: Bytes of text for each range of minimizers, which meets in one task; where there is little text, down to a 32nd of that.
RANGE_BYTES = 16 << 20
#: Texts, at least, that make a minimizer hot; and the strings of which a task remembers that it has sent them.
HOT, SEEN = 2_000, 1_000_000
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def gram_hashes(body: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes in a row; gram: a multiple of 8."""
    n = len(body) - 7
    words = np.empty(n, np.uint64)
    for o in range(8):
        lane = body[o : o + (len(body) - o) // 8 * 8].view("<u8")
        words[o::8] = lane[: len(words[o::8])]
    size = len(body) - gram + 1
    out = np.zeros(size, np.uint64)
    for k in range(0, gram, 8):
        out += words[k : k + size]
        out *= _M1 if k == 0 else _M2 if k == 8 else _M3
        out ^= out >> np.uint64(29)
    out *= _M4
    out ^= out >> np.uint64(32)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - reach : width - reach + len(values) - width + 1])


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM, together: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, minimizer) of each run of windows with one minimizer; about `together` bytes are hashed at a time."""
    parts, at = [], 0
    while at < len(texts) or not parts:
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= together):
            size += len(texts[stop])
            stop += 1
        text, *rest = _segments(texts[at:stop], width, gram)
        parts.append((text + at, *rest))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _segments(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if not len(sizes) or sizes.sum() < width:
        return empty
    lows = sliding_min(gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram), width - gram + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(lows)]
    inside = np.arange(len(lows)) + width <= (starts + sizes)[owner]
    new = np.ones(len(lows), bool)
    new[1:] = (lows[1:] != lows[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new & inside)
    if not len(at):
        return empty
    edge = np.flatnonzero(new | ~inside)
    after = np.searchsorted(edge, at, "right")
    stop = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], len(lows)) - 1
    text = owner[at]
    return text, at - starts[text], stop - starts[text], lows[at]


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _order_id(key: str) -> Column:
    """Null ids stand above all others."""
    return F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))


def _runs(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows) of each value of part."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(part[rows[0]]), rows


#: Hashes travel as their upper five bytes: where two that differ meet, that adds a candidate and loses none.
SHORT = np.uint64(24)


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) >> SHORT


def _squeeze(*columns: tuple[np.ndarray, int]) -> bytes:
    """Integer columns, each with the number of its low bytes to keep, as planes of bytes that zstandard has compressed: planes of ids and
    starts that hardly change cost next to nothing."""
    import zstandard

    planes = [np.ascontiguousarray(c.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes() for c, k in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(blob: bytes, *widths: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for k in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = raw[at : at + n * k].reshape(k, n).T
        out.append(wide.view("<i8").ravel())
        at += n * k
    return out


def _spread_all(blobs: list[bytes], *widths: int) -> list[np.ndarray]:
    parts = [_spread(b, *widths) for b in blobs]
    return [np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts, strict=True) if parts else [[]] * len(widths))]


def _squeezed_texts(df: DataFrame) -> DataFrame:
    """df (id, rid, text) with the text compressed, for exchanges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in byte_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array([press(b) for b in _bytes(batch)], pa.binary())], names=["id", "rid", "body"])

    return df.select("id", "rid", "text").mapInArrow(run, "id long, rid long, body binary")


def _opened(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with a column `body` of compressed texts, and the texts: about `most` bytes at a time."""
    import zstandard

    press = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        bodies, size, at = [], 0, 0
        for k in range(batch.num_rows):
            bodies.append(press(batch.column("body")[k].as_py()))
            size += len(bodies[-1])
            if size >= most or k + 1 == batch.num_rows:
                yield batch.slice(at, k + 1 - at), bodies
                bodies, size, at = [], 0, k + 1


def shared_minimizers(texts: DataFrame, parts: int, hot: int, width: int, gram: int) -> DataFrame:
    """(short, minimizers, hot): for each text, by its short rid, packed, those of its minimizers that another text has too; and one row, `hot`, of the
    minimizers that at least `hot` texts have.

    Rows hold many entries each: minimizers travel by range, answers by bucket of texts, so the number of rows depends on tasks, ranges and buckets only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches):
            rids = _short(batch.column("rid").to_numpy())
            text, _, _, value = segments(_bytes(batch), width, gram)
            value = _short(value)
            order = np.lexsort((text, value))
            text, value = text[order], value[order]
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
            text, value = text[first], value[first]
            lead = np.ones(len(text), bool)
            lead[1:] = value[1:] != value[:-1]
            run = np.cumsum(lead) - 1
            times = np.bincount(run, minlength=1)
            known = (times > 1)[run] if len(run) else lead
            here, mine = rids[text[known]], value[known]
            rows = [(-1 - p, _squeeze((here[r], 5), (mine[r], 5))) for p, r in _runs((here % np.uint64(parts)).astype(np.int64))]
            here, mine = rids[text[lead]], value[lead]
            rows += [(p, _squeeze((here[r], 5), (mine[r], 5), (np.minimum(times[r], 0xFFFFFF), 3))) for p, r in _runs((mine % np.uint64(parts)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])
        give_back()

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if int(frame["part"].iloc[0]) < 0:
            rids, value = _spread_all(frame["blob"], 5, 5)
            often = value[:0]
        else:
            rids, value, times = _spread_all(frame["blob"], 5, 5, 3)
            order = np.argsort(value, kind="stable")
            rids, value, times = rids[order], value[order], times[order]
            at = np.flatnonzero(np.diff(value, prepend=-1) != 0)
            total = np.add.reduceat(times, at) if len(at) else at
            often = value[at[total >= hot]]
            rows = (np.repeat(total, np.diff(np.append(at, len(value)))) > 1) & (times == 1)
            rids, value = rids[rows], value[rows]
        out = [(p, _squeeze((rids[r], 5), (value[r], 5))) for p, r in _runs(rids % parts)]
        if len(often):
            out.append((-1, _squeeze((often, 5))))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        if int(frame["bucket"].iloc[0]) < 0:
            (often,) = _spread_all(frame["blob"], 5)
            return pd.DataFrame([(None, _squeeze((np.sort(often), 5)), True)], columns=["short", "minimizers", "hot"])
        rids, value = _spread_all(frame["blob"], 5, 5)
        order = np.lexsort((value, rids))
        rids, value = rids[order], value[order]
        return pd.DataFrame([(k, _squeeze((value[r], 5)), False) for k, r in _runs(rids)], columns=["short", "minimizers", "hot"])

    sent = texts.mapInArrow(send, "part int, blob binary")
    answers = sent.groupBy("part").applyInPandas(answer, "bucket int, blob binary")
    return answers.groupBy("bucket").applyInPandas(gather, "short long, minimizers binary, hot boolean")


def _gram_places(strings: list[bytes], values: np.ndarray, gram: int) -> np.ndarray:
    """Where the minimizer, given as its short hash, stands in each string; -1 where it does so more than once."""
    out, at = np.empty(len(strings), np.int64), 0
    while at < len(strings):
        stop, size = at, 0
        while stop < len(strings) and size < 1 << 20:
            size += len(strings[stop])
            stop += 1
        part = strings[at:stop]
        sizes = np.array([len(b) for b in part])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(part)), sizes)
        hashes = _short(gram_hashes(np.frombuffer(b"".join(part), np.uint8), gram)).view(np.int64)
        hit = np.flatnonzero(hashes == values[at:stop][owner[: len(hashes)]])
        hit = hit[hit + gram <= (starts + sizes)[owner[hit]]]
        place = np.full(len(part), -1)
        place[owner[hit]] = hit - starts[owner[hit]]
        place[np.bincount(owner[hit], minlength=len(part)) != 1] = -1
        out[at:stop], at = place, stop
    return out


def _sides(body: bytes, place: int, width: int, gram: int) -> list[tuple[int, bytes]]:
    """Keys of the bytes around the gram at `place`. All strings of a minimizer hold the same gram, and an equal window needs width - gram equal bytes around it:
    `l` to the left and the rest to the right. For l in each quarter, both strings have the quarter's least l on the left and its least rest on the right in
    common, so strings without a key in common share no window."""
    around, out = width - gram, []
    cuts = [around * k // 4 for k in range(4)] + [around + 1]
    for k, (l, nxt) in enumerate(zip(cuts, cuts[1:], strict=False)):
        r = around - nxt + 1
        if place >= l and len(body) >= place + gram + r:
            out.append((k, body[place - l : place] + body[place + gram : place + gram + r]))
    return out


def _split(strings: list[bytes], places: list[int], width: int, gram: int, together: int) -> list[list[int]]:
    """Groups of the strings that may share a window: all that have a key in common with another one, or, where these are more than `together` bytes, those of
    each key on their own."""
    seen: dict[tuple[int, bytes], list[int]] = {}
    for i, (b, q) in enumerate(zip(strings, places, strict=True)):
        for k in _sides(b, q, width, gram):
            seen.setdefault(k, []).append(i)
    shared = [own for own in seen.values() if len(own) > 1]
    every = sorted({i for own in shared for i in own})
    return shared if sum(len(strings[i]) for i in every) > together else [every] if every else []


def _common(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one: of all others, a neighbour in sorted order shares the most."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        a, b = parts[i], parts[j]
        n = min(len(a), len(b))
        n -= (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7 >> 3
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _resolve(ids: np.ndarray, rids: np.ndarray, starts: np.ndarray, groups_of: np.ndarray, value: np.ndarray, bodies: list[bytes], width: int, gram: int, together: int = 150_000) -> list[tuple[int, int, int, int]]:
    """(id, rid, first byte, byte after) of the windows that an equal window with a smaller id covers, of segments in groups with one minimizer (value) each.

    Different strings of one group go through suffix arrays, about `together` bytes at a time; the gram that they share counts as one symbol there."""
    found, groups, at = [], [], []
    for _, rows in _runs(groups_of):
        strings: dict[bytes, list[int]] = {}
        for r in rows.tolist():
            strings.setdefault(bodies[r], []).append(r)
        if len(strings) > 1:
            groups.append(strings)
            at.append(value[rows[0]])
        for body, own in strings.items():
            if len(own) > 1:
                least = min(int(ids[r]) for r in own)
                found += [(int(ids[r]), int(rids[r]), int(starts[r]), int(starts[r]) + len(body)) for r in own if ids[r] > least]
    every = [b for g in groups for b in g]
    places = _gram_places(every, np.repeat(np.array(at, np.int64), [len(g) for g in groups]), gram) if every else None
    texts: dict[int, list] = {1: [], gram: []}  # by the bytes that the gram's one symbol stands for
    held = serial = done = 0

    def flush(short: int) -> None:
        rows, texts[short] = texts[short], []
        if not rows:
            return
        classes = window_classes([t for t, *_ in rows], width - short + 1)
        size = [len(c) for c in classes]
        keys = np.repeat(np.array([g for _, g, *_ in rows]), size) * (sum(size) + 1) + np.concatenate(classes)
        names, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, np.repeat(np.array([min(int(ids[r]) for r in own) for *_, own, _ in rows], np.int64), size))
        low = np.split(least[inverse], np.cumsum(size)[:-1])
        for (_, _, own, shift), lows in zip(rows, low, strict=True):
            for r in own:
                cut = np.flatnonzero(lows < ids[r])
                if len(cut):
                    at = int(starts[r]) + shift
                    for run in np.split(cut, np.flatnonzero(np.diff(cut) > 1) + 1) if cut[-1] - cut[0] >= len(cut) else (cut,):
                        found.append((int(ids[r]), int(rids[r]), at + int(run[0]), at + int(run[-1]) + width))

    around = width - gram
    for strings in groups:
        keys, where = list(strings), places[done : done + len(strings)].tolist()
        done += len(strings)
        short = gram if min(where) >= 0 else 1
        for own in _split(keys, where, width, gram, together) if short > 1 else [range(len(keys))]:
            serial += 1
            if short == 1:
                for i in own:
                    texts[1].append((keys[i], serial, strings[keys[i]], 0))
                    held += len(keys[i])
            else:
                # What no other string shares with this one on either side of the gram is in no equal window.
                lefts = _common([keys[i][max(where[i] - around, 0) : where[i]][::-1] for i in own])
                rights = _common([keys[i][where[i] + gram : where[i] + gram + around] for i in own])
                for i, a, z in zip(own, lefts, rights, strict=True):
                    if a + z >= around:
                        b, q = keys[i], where[i]
                        # 0xff is in no UTF-8 text, so it can stand for the gram.
                        texts[gram].append((b[q - a : q] + b"\xff" + b[q + gram : q + gram + z], serial, strings[b], q - a))
                        held += a + z + 1
            if held >= together:
                flush(1)
                flush(gram)
                held = 0
    flush(1)
    flush(gram)
    return found


def _merged(spans: np.ndarray) -> np.ndarray:
    """Half-open [a, b) rows in order, those that touch joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > ends[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], ends[np.append(at[1:], len(spans)) - 1]], 1)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: (doc_id, id, rid, n_bytes, sha256, copy) of each row, copy where a smaller id has the same text. spans:
    (id, rid, spans) of the other rows that lose bytes, spans packed as 64-bit [from, to) pairs, merged and in order. id is
    the key with nulls as the largest long, rid a hash of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rid = F.xxhash64(body)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _order_id(key).alias("id"), rid.alias("rid"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha256"))
    rows = durable(rows, "texts")
    least = rows.groupBy("sha256").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("sha256", "least")
    rows = rows.join(broadcast_if_small(durable(least, "repeated-texts"), most=100_000), "sha256", "left")
    rows = durable(rows.withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("least"), "texts")
    total = rows.filter("not copy").agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-int(total) // RANGE_BYTES), min(96, int(total) // (RANGE_BYTES // 32)))

    copies = durable(rows.filter("copy").select(F.col("id").alias("copy_id"), F.col("rid").alias("copy_rid")).distinct(), "copies")
    source = docs.select(_order_id(key).alias("id"), rid.alias("rid"), body.alias("text")).filter(F.octet_length("text") >= width)
    source = source.join(broadcast_if_small(copies), (F.col("id") == F.col("copy_id")) & (F.col("rid") == F.col("copy_rid")), "left_anti")
    # A minimizer that very many texts have is met by its neighbourhood too: there are at most 50,000 such minimizers.
    hot = max(HOT, int(total) // (width - gram) // 25_000)
    shared = durable(shared_minimizers(source.select("rid", "text"), parts, hot, width, gram), "shared-minimizers")
    often = shared.filter("hot").select("minimizers").first()
    often = _spread(bytes(often[0]), 5)[0] if often else np.empty(0, np.int64)
    shared = shared.filter("not hot").select("short", "minimizers")
    near = _squeezed_texts(source).join(shared, F.shiftrightunsigned("rid", int(SHORT)) == F.col("short")).select("id", "rid", "body", "minimizers")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        seen: dict[int, int] = {}
        for batch, texts in _opened(batches):
            order = np.argsort(batch.column("id").to_numpy(), kind="stable")
            batch, texts = batch.take(pa.array(order)), [texts[k] for k in order.tolist()]
            ids, rids = batch.column("id").to_numpy(), batch.column("rid").to_numpy()
            wanted = np.unique(_spread_all(batch.column("minimizers").to_pylist(), 5)[0])
            of, first, last, value = segments(texts, width, gram)
            value = _short(value).view(np.int64)
            mine = wanted[np.minimum(np.searchsorted(wanted, value), max(len(wanted) - 1, 0))] == value if len(wanted) else np.zeros(len(value), bool)
            of, first, last, value = of[mine], first[mine], last[mine], value[mine]
            # A string that this task has sent for a smaller id needs no second trip: its bytes go.
            go, bodies, gone = [], [], []
            for k, (t, a, z) in enumerate(zip(of.tolist(), first.tolist(), last.tolist(), strict=True)):
                b = texts[t][a : z + width]
                key = _digest(b)
                least = seen.get(key)
                if least is not None and least < ids[t]:
                    gone.append((t, a, z + width))
                elif least is None or least > ids[t]:
                    seen[key] = int(ids[t])
                    go.append(k)
                    bodies.append(b)
                # An equal id is the same document or one that repeats its id: neither takes from the other, but both may lose.
                else:
                    go.append(k)
                    bodies.append(b)
            if len(seen) > SEEN:
                seen.clear()
            g = np.array(gone, np.int64).reshape(-1, 3)
            rows = [(-1 - p, _squeeze((ids[g[r, 0]], 8), (rids[g[r, 0]], 8), (g[r, 1], 5), (g[r, 2], 5)), b"") for p, r in _runs(rids[g[:, 0]] % parts)]
            go = np.array(go, np.int64)
            at, keys = np.arange(len(go)), value[go]
            for k in np.flatnonzero(np.isin(value[go], often)).tolist():
                more = _neighbours(bodies[k], int(value[go[k]]), width, gram)
                at, keys = np.concatenate([at, np.full(len(more), k)]), np.concatenate([keys, more])
            plain = ~np.isin(keys, often)
            at, keys = at[plain], keys[plain]
            for p, r in _runs(keys % parts):
                own, body = go[at[r]], [bodies[x] for x in at[r].tolist()]
                rows.append((p, _squeeze((ids[of[own]], 8), (rids[of[own]], 8), (first[own], 5), (keys[r], 8), (value[own], 5), (np.array(list(map(len, body))), 5)), press(b"".join(body))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "blob", "bodies"])
        give_back()

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if int(frame["part"].iloc[0]) < 0:
            ids, rids, a, z = _spread_all(frame["blob"], 8, 8, 5, 5)
            spans = np.stack([a, z], 1)
        else:
            ids, rids, starts, keys, value, sizes = _spread_all(frame["blob"], 8, 8, 5, 8, 5, 5)
            press, bodies, ends = zstandard.ZstdDecompressor().decompress, [], np.cumsum(sizes)
            whole = b"".join(press(b) for b in frame["bodies"])
            bodies = [whole[z - n : z] for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            found = np.array(_resolve(ids, rids, starts, keys, value, bodies, width, gram), np.int64).reshape(-1, 4)
            ids, rids, spans = found[:, 0], found[:, 1], found[:, 2:]
            del whole, bodies
            give_back()
        return pd.DataFrame([(p, _squeeze((ids[r], 8), (rids[r], 8), (spans[r, 0], 5), (spans[r, 1], 5))) for p, r in _runs(rids % parts)], columns=["bucket", "blob"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids, rids, a, z = _spread_all(frame["blob"], 8, 8, 5, 5)
        spans = np.stack([a, z], 1)
        order = np.lexsort((rids, ids))
        ids, rids, spans = ids[order], rids[order], spans[order]
        new = np.flatnonzero((np.diff(ids) != 0) | (np.diff(rids) != 0)) + 1
        own = np.split(np.arange(len(ids)), new) if len(ids) else []
        return pd.DataFrame([(int(ids[r[0]]), int(rids[r[0]]), _merged(spans[r]).tobytes()) for r in own], columns=["id", "rid", "spans"])

    sent = near.mapInArrow(send, "part int, blob binary, bodies binary")
    cut = sent.groupBy("part").applyInPandas(resolve, "bucket int, blob binary")
    spans = cut.groupBy("bucket").applyInPandas(join, "id long, rid long, spans binary")
    return rows, durable(spans, "spans")


def _digest(body: bytes) -> int:
    """128 bits: equal ones are taken for equal strings."""
    import xxhash

    return xxhash.xxh3_128_intdigest(body)


def _neighbours(body: bytes, value: int, width: int, gram: int) -> np.ndarray:
    """Keys to meet other strings of a hot minimizer by: some for each place where it stands."""
    import xxhash

    hashes = _short(gram_hashes(np.frombuffer(body, np.uint8), gram)).view(np.int64)
    keys = {xxhash.xxh64_intdigest(bytes([side]) + near, value) >> 1 for q in np.flatnonzero(hashes == value).tolist() for side, near in _sides(body, q, width, gram)}
    return np.array(sorted(keys), np.int64)


def _kept(body: bytes, spans: bytes) -> bytes:
    at, out = 0, []
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    Null text: empty. Texts below `width` bytes lose nothing and take nothing. Null ids stand above all others and take nothing from one
    another; nor do rows that repeat an id. Empty table: empty result.
    """
    rows, spans = repeated_spans(docs, width, gram, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(_order_id(key).alias("id"), F.xxhash64(body).alias("rid"), body.alias("text"))
    named = spans.withColumnsRenamed({"id": "cut_id", "rid": "cut_rid"})
    on = (F.col("id") == F.col("cut_id")) & (F.col("rid") == F.col("cut_rid"))
    source = source.join(broadcast_if_small(named.select("cut_id", "cut_rid"), most=250_000), on, "left_semi")
    source = _squeezed_texts(source).join(named, on).select("id", "rid", "body", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _opened(batches):
            out = []
            for b, s in zip(texts, batch.column("spans").to_pylist(), strict=True):
                kept = _kept(b, s)
                out.append((len(b) - len(kept), len(s) // 16, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["cut_id", "cut_rid", "n_removed", "n_spans", "kept"])

    cut = durable(source.mapInArrow(digest, "cut_id long, cut_rid long, n_removed long, n_spans long, kept string").distinct(), "cut")
    whole = F.col("copy") & (F.col("n_bytes") >= width)
    zero = F.lit(0).cast("long")
    return rows.join(broadcast_if_small(cut, most=50_000), on, "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of the text (and `chars` counted anew, where there is such a column); no row goes. Bytes of a character that was cut in part go too."""
    rows, spans = repeated_spans(docs, width, gram, key, text)
    gone = rows.filter(F.col("copy") & (F.col("n_bytes") >= width)).select("id", "rid", F.lit(None).cast("binary").alias("spans")).distinct()
    marks = durable(spans.unionByName(gone).withColumnsRenamed({"id": "__cut_id", "rid": "__cut_rid", "spans": "__cut_spans"}), "cuts")
    body = F.coalesce(F.col(text), F.lit(""))
    on = (_order_id(key) == F.col("__cut_id")) & (F.xxhash64(body) == F.col("__cut_rid"))
    cut_ids = broadcast_if_small(marks.select("__cut_id", "__cut_rid"), most=250_000)
    columns = docs.columns
    same = docs.join(cut_ids, on, "left_anti")
    changed = docs.join(cut_ids, on, "left_semi").join(marks, on).drop("__cut_id", "__cut_rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, text):
            bodies = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            kept = [b"" if s is None else _kept(b, s) for b, s in zip(bodies, batch.column("__cut_spans").to_pylist(), strict=True)]
            new = {text: pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())}
            if chars in batch.schema.names:
                new[chars] = pa.array([len(x) for x in new[text].to_pylist()], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in columns], names=columns)

    return same.unionByName(changed.mapInArrow(cut, docs.schema))
