"""SimHash near-duplicates: a self-join of a binary trie of fingerprints, then connected components.

Equal fingerprints collapse before anything is joined. The trie's top levels are cut off as subtrees, a subtree with very many fingerprints
further down, and pairs of subtrees whose prefixes differ in no more bits than the budget travel together; within a pair, node pairs are walked bit by
bit with the differing bits added up, and dropped when they exceed the budget. A fingerprint meets a bounded number of others,
however large its cluster, and of the links found in a pair of subtrees only a spanning forest leaves the task.

near_duplicates() links fingerprints by their distance alone. similar() links texts by an exact similarity: a fingerprint of TRIES runs of WIDTH bits gives as many
tries, each with a small budget, and what any of them proposes is verified. Tries and forests may leave links out, so an exact pass follows: texts of different
components that share one of their rarest shingles meet, and all that can reach the similarity are verified too. Links are lost nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import broadcast_if_small, byte_chunks, durable, give_back, texts_of

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints in a subtree, about; the cut moves down as their number grows.
SUBTREE = 8192
#: similar(): words in a shingle, least similarity, tries, bits of each and the budget there, fingerprints in a subtree, most of all the bits that may differ,
#: spanning forests of candidates.
WORDS, SIMILARITY, TRIES, WIDTH, BUDGET, WIDE_SUBTREE, APART, FORESTS = 5, 0.8, 24, 32, 2, 131_072, 160, 4
#: Node pairs walked at once.
FRONT = 1 << 16
#: The exact pass: bits of the parity that bounds an overlap, least count of a shingle that has a place in the order of all, such shingles at most, shingles counted
#: at once, ranges they are counted in, bytes of prefixes met in a task, pairs met at once.
PARITY, OFTEN, KNOWN, COUNTED, CELLS, MET, MEETINGS = 1024, 4, 1 << 20, 1 << 21, 1024, 8 << 20, 1 << 20
#: Links that a task joins to trees.
LINKS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_KEYS = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _bit_counts(rows: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """How many rows of bytes have each bit, by counts of the values of each byte; `most` rows at a time."""
    width = rows.shape[1]
    lanes, values = np.arange(width, dtype=np.int32) * 256, np.zeros(width * 256, np.int64)
    for at in range(0, len(rows), most):
        values += np.bincount((rows[at : at + most] + lanes).ravel(), minlength=width * 256)
    return values.reshape(width, 256) @ _BITS



def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 where over half of the word shingles' XXH64 have it. Fewer words than a shingle: the whole sequence; none: 0."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xx(b" ".join(words), seed)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    hashes = np.array([xx(body[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = _bit_counts(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches):
            found = np.array([fingerprint(x, shingle) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], names=["doc_id", "fp"])
        give_back()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union by smallest index, in numpy."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two trees."""
        up, joined = self.up, np.zeros(len(u), bool)
        at = np.arange(len(u))
        while len(at):
            a, b = up[u[at]], up[v[at]]
            apart = a != b
            at, a, b = at[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(up, high, low)
            made = np.flatnonzero(up[high] == low)
            joined[at[made[np.unique(high[made], return_index=True)[1]]]] = True
            while (higher := up[up] != up).any():
                up[higher] = up[up[higher]]
        return joined


def walk(a: np.ndarray, b: np.ndarray, low: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted unsigned a and b that differ in at most `budget` of the `low` low bits. same: a is b, each pair once."""
    zeros = lambda x, bit: np.concatenate([[0], np.cumsum(((x >> np.uint64(bit)) & np.uint64(1)) == 0)])
    split = [(zeros(a, d), None if same else zeros(b, d)) for d in range(low)]
    stack = [(low, np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64))]
    while stack:
        depth, at = stack.pop()
        a0, a1, b0, b1, err = at
        na, nb = a1 - a0, b1 - b0
        small = na * nb <= 16
        if depth == 0:
            small[:] = True
        if small.any():
            x0, xb, nx, ny = a0[small], b0[small], na[small], nb[small]
            total = nx * ny
            of = np.repeat(np.arange(len(total)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i, j = x0[of] + k // ny[of], xb[of] + k % ny[of]
            near = np.bitwise_count((a[i] ^ b[j]) & np.uint64((1 << low) - 1)) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
            at = at[:, ~small]
            if not at.shape[1]:
                continue
            a0, a1, b0, b1, err = at
        if at.shape[1] > FRONT:
            half = at.shape[1] // 2
            stack += [(depth, at[:, :half]), (depth, at[:, half:])]
            continue
        za, zb = split[depth - 1]
        zb = za if same else zb
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        kids = [np.stack([a0, am, b0, bm, err]), np.stack([am, a1, bm, b1, err]), np.stack([a0, am, bm, b1, err + 1])]
        mirror = np.stack([am, a1, b0, bm, err + 1])
        kids.append(mirror[:, (a0 != b0) | (a1 != b1)] if same else mirror)
        nxt = np.concatenate(kids, 1)
        nxt = nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)]
        if nxt.shape[1]:
            stack.append((depth - 1, nxt))


def _entry(tries: int) -> np.dtype:
    """What travels of a fingerprint: 64 bits that are their own node, or WIDTH bits with a node and its number of shingles."""
    return np.dtype([("fp", "<u8")] if tries == 1 else [("fp", "<u4"), ("n", "<i4"), ("node", "<i8")])


def _cut(fp: np.ndarray, low: int, deep: np.ndarray) -> np.ndarray:
    """The `deep` bits below the prefix."""
    deep = deep.astype(np.uint64)
    return (fp.astype(np.uint64) >> (np.uint64(low) - deep)) & ((np.uint64(1) << deep) - np.uint64(1))


def _fps(batch: pa.RecordBatch, tries: int) -> np.ndarray:
    """Fingerprints of the rows, a column for each trie."""
    if tries == 1:
        return batch.column("fp").to_numpy().view("<u8")[:, None]
    return np.frombuffer(b"".join(batch.column("print").to_pylist()), "<u4").reshape(batch.num_rows, tries)


def _crowded(prints: DataFrame, low: int, tries: int, most: int) -> DataFrame:
    """(trie, prefix, n) of the prefixes, the bits above the `low` ones, that more than `most` rows have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fps(batch, tries)
            for t in range(tries):
                prefix, n = np.unique(fps[:, t] >> fps.dtype.type(low), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(prefix.astype(np.int32)), pa.array(n)], names=["trie", "prefix", "n"])

    return prints.mapInArrow(count, "trie int, prefix int, n long").groupBy("trie", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > most)


def _subtrees(prints: DataFrame, low: int, tries: int, heavy: dict[tuple[int, int], int]) -> DataFrame:
    """(trie, prefix, deep, sub, blobs): packed entries of each subtree, a blob for each batch of rows that has some."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fps, rows = np.zeros(batch.num_rows, _entry(tries)), _fps(batch, tries), []
            if tries > 1:
                own["n"], own["node"] = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            for t in range(tries):
                own["fp"] = fps[:, t]
                prefix = (fps[:, t] >> fps.dtype.type(low)).astype(np.int64)
                deep = np.zeros(len(own), np.int64)
                for (trie, p), d in heavy.items():
                    if trie == t:
                        deep[prefix == p] = d
                sub = np.where(deep > 0, _cut(fps[:, t], low, deep).astype(np.int64), 0)
                order = np.lexsort((sub, prefix))
                new = np.flatnonzero((np.diff(prefix[order]) != 0) | (np.diff(sub[order]) != 0)) + 1
                rows += [(t, int(prefix[r[0]]), int(deep[r[0]]), int(sub[r[0]]), own[r].tobytes()) for r in np.split(order, new) if len(r)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["trie", "prefix", "deep", "sub", "blob"])

    packed = prints.mapInArrow(pack, "trie int, prefix int, deep int, sub int, blob binary")
    return packed.groupBy("trie", "prefix", "deep", "sub").agg(F.collect_list("blob").alias("blobs"))


def trie_links(prints: DataFrame, n: int, bits: int = 64, radius: int = RADIUS, subtree: int = SUBTREE, tries: int = 1, forests: int = 1) -> DataFrame:
    """(u, v): pairs of nodes that connect the same nodes as all pairs of one trie within the radius do; with more `forests`, also when some of them are
    taken away: so many spanning forests of each pair of subtrees, none with a pair of another, which for up to that many nodes and one are all pairs.

    prints: distinct (fp), 64 bits that are nodes themselves; or, for `tries` of `bits` bits, (node, n, print), print holding a run of bits for each. `n`
    rows in all. Nodes that share a fingerprint are linked in the order of their column n."""
    top = min(24, max(2, (max(n, 1) // subtree).bit_length()))
    masks = [sum(1 << b for b in own) for k in range(min(radius, top) + 1) for own in combinations(range(top), k)]
    low = bits - top
    # Prefixes with far more than their share are cut further down: there are at most n / subtree of them in a trie.
    heavy = {(r["trie"], r["prefix"]): min(16, low, (r["n"] // subtree).bit_length() + 1) for r in _crowded(prints, low, tries, 2 * subtree).collect()}
    nodes = durable(_subtrees(prints, low, tries, heavy), "subtrees")
    left = nodes.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    right = nodes.select(*[F.col(c).alias(f"{c}_r") for c in nodes.columns])
    left = left.withColumn("other", F.col("prefix").bitwiseXOR(F.col("mask"))).filter("prefix <= other")
    common = F.least("deep", "deep_r")
    cut = lambda s, d: F.call_function("shiftrightunsigned", F.col(s), F.col(d) - common)
    used = F.bit_count("mask") + F.bit_count(cut("sub", "deep").bitwiseXOR(cut("sub_r", "deep_r")))
    same = (F.col("mask") == 0) & (F.col("sub") == F.col("sub_r"))
    pairs = left.join(right, (F.col("trie") == F.col("trie_r")) & (F.col("other") == F.col("prefix_r"))).filter((used <= radius) & ((F.col("mask") != 0) | (F.col("sub") <= F.col("sub_r"))))
    pairs = pairs.select("trie", "prefix", "sub", "prefix_r", "sub_r", F.bit_count("mask").alias("used"), "blobs", F.when(~same, F.col("blobs_r")).alias("blobs_r"), same.alias("same"))
    pairs = pairs.repartition(max(12, min(4096, (len(masks) * tries << top) * subtree >> 19)), "trie", "prefix", "sub", "prefix_r", "sub_r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = lambda name, k=k: _distinct(np.frombuffer(b"".join(batch.column(name)[k].as_py()), _entry(tries)))  # noqa: B023, E731
                same = batch.column("same")[k].as_py()
                sides = [one("blobs")] if same else [one("blobs"), one("blobs_r")]
                ids = np.concatenate([s[1] for s in sides])
                found = [(s[2], s[3]) for s in sides] if same else []
                shift, woods = 0 if same else len(sides[0][0]), [Forest(len(ids)) for _ in range(forests)]
                for i, j in walk(sides[0][0], sides[-1][0], low, radius - batch.column("used")[k].as_py(), same):
                    j = j + shift
                    for forest in woods:  # what one leaves goes to the next
                        joined = forest.link(i, j)
                        found.append((ids[i[joined]], ids[j[joined]]))
                        i, j = i[~joined], j[~joined]
                u, v = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        give_back()

    return pairs.mapInArrow(run, "u long, v long")


def _distinct(entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct fingerprints in order, a node of each, chains of the nodes that share one)."""
    fps = entries["fp"].astype(np.uint64)
    ids, n = (entries["node"], entries["n"]) if "node" in entries.dtype.names else (fps.view(np.int64), np.zeros(len(fps), np.int8))
    order = np.lexsort((ids, n, fps))
    fps, ids = fps[order], np.ascontiguousarray(ids[order])
    new = np.ones(len(fps), bool)
    new[1:] = fps[1:] != fps[:-1]
    again = np.flatnonzero(~new)
    return fps[new], ids[new], ids[again - 1], ids[again]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: component_id is the smallest doc_id that links reach, itself included.

    Null or empty text: fingerprint zero, linked like any other. Repeated rows: a row each. Null keys: a row each, never
    a component's id unless it has no other. Empty table: empty result. Other columns are not read.
    """
    prints = durable(fingerprints(docs, shingle, key, text), "fingerprints")
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = trie_links(distinct.select("fp"), distinct.count(), 64, radius, SUBTREE)
    roots = graph.components(durable(links, "links"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = durable(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = durable(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(broadcast_if_small(classes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashed(text: str) -> tuple[bytes, np.ndarray]:
    """(the words in order, hashes of their shingles)."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode().translate(_LOWER).split()
    body = b" ".join(words)
    if len(words) <= WORDS:
        return body, np.array([xx(body, SEED)] if words else [], np.uint64)
    return body, _shingles(words, body)


def _wide(body: bytes, hashes: np.ndarray) -> tuple[int, int, bytes]:
    """(hash of the words in order, number of shingles, fingerprint of TRIES * WIDTH bits over the shingles)."""
    from xxhash import xxh64_intdigest as xx

    bits = TRIES * WIDTH
    if not len(hashes):
        return xx(body, SEED + 1), 0, bytes(bits // 8)
    mixed = (hashes[:, None] + _KEYS[: bits // 64]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    counts = _bit_counts(mixed.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), bits // 8))
    return xx(body, SEED + 1), len(hashes), np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes()


def _shingles(words: list[bytes], body: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest as xx

    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-WORDS]]).tolist()
    return np.array([xx(body[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _elements(hashes: np.ndarray) -> np.ndarray:
    """Shingles as a set, in order: the k-th copy of one is an element of its own, so that sets overlap as multisets do."""
    h = np.sort(hashes)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    copy = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return np.sort(h + copy.astype(np.uint64) * _KEYS[1]) if copy.any() else h


def _parity(elements: np.ndarray) -> bytes:
    """How many elements fall to each of PARITY bits, modulo 2. Two sets differ in at least as many elements as their parities in bits."""
    return np.packbits((np.bincount((elements & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).tobytes()


def _prefix(elements: np.ndarray, similarity: float, known: np.ndarray, counts: np.ndarray) -> bytes:
    """The elements that come first, by the counts of their high halves among the known ones (others: 0), then by themselves: so many that sets of the similarity share
    one of them."""
    if len(known):
        high = (elements >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(known, high), len(known) - 1)
        elements = elements[np.argsort(np.where(known[at] == high, counts[at], 0), kind="stable")]
    return elements[: len(elements) - _least(similarity, len(elements)) + 1].astype("<u8").tobytes()


def _least(share: float, n: int) -> int:
    return int(np.ceil(share * n - 1e-9))


def _gaps(values: np.ndarray) -> bytes:
    """Sorted 32-bit values, two bytes each where the gaps allow it."""
    gaps = np.diff(values)
    if len(gaps) and gaps.max() < 1 << 16:
        return b"\1" + values[:1].astype("<u4").tobytes() + gaps.astype("<u2").tobytes()
    return b"\0" + values.astype("<u4").tobytes()


def _ungapped(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.cumsum(np.concatenate([np.frombuffer(raw, "<u4", 1, 1), np.frombuffer(raw, "<u2", -1, 5)]), dtype=np.uint32)
    return np.frombuffer(raw, "<u4", -1, 1)


def _common(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(high halves, counts) of the elements that all the texts have most often, exact up to elements of one high half and copies of a text. They give an order and
    decide what the exact pass costs, not what it finds."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def told() -> pa.RecordBatch:
            values = np.sort(np.concatenate([*held, np.zeros(0, np.uint32)]))
            cell = (values.astype(np.uint64) * np.uint64(CELLS)) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(values)] if len(values) else [0]
            return pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]].astype(np.int32)), pa.array([_gaps(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["cell", "blob"])

        for batch in byte_chunks(batches):
            for t in texts_of(batch):
                body, hashes = _hashed(t)
                if len(hashes) and (own := hash(body)) not in seen:  # once in a task
                    seen.add(own)
                    held.append((_elements(hashes) >> np.uint64(32)).astype(np.uint32))
                    size += len(held[-1])
                if size > COUNTED:
                    yield told()
                    held, size = [], 0
        yield told()
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for cell, blob in zip(batch.column("cell").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs.setdefault(cell, []).append(blob)
        while blobs:
            found, n = np.unique(np.concatenate([_ungapped(b) for b in blobs.popitem()[1]]), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int32)), pa.array(np.minimum(n[often], (1 << 31) - 1).astype(np.int32))], names=["high", "n"])
        give_back()

    dealt = source.select("text").mapInArrow(deal, "cell int, blob binary")
    counted = durable(dealt.repartition("cell").mapInArrow(count, "high int, n int"), "counts")
    least, left = OFTEN, KNOWN
    # By powers of two, of which there are few: as many of the largest as there is room for.
    sizes = {r["bits"]: r["count"] for r in counted.groupBy((F.length(F.bin("n")) - 1).alias("bits")).count().collect()}
    for bits in sorted(sizes, reverse=True):
        least, left = 1 << bits, left - sizes[bits]
        if left < 0:
            least *= 2
            break
    most = counted.filter(F.col("n") >= least).toArrow()
    known, counts = (most.column(c).to_numpy() for c in ("high", "n"))
    known = known.view(np.uint32)
    order = np.argsort(known)
    give_back()
    return known[order], counts[order]


_MET = np.dtype([("h", "<u4"), ("at", "<i4"), ("n", "<i4"), ("node", "<i8"), ("root", "<i8")])


def _meetings(met: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v): pairs of nodes of different roots that share an element and can reach the similarity if it is the first that they share."""
    met = met[np.lexsort((met["at"], met["node"], met["root"], met["h"]))]
    changed = lambda c: met[c][1:] != met[c][:-1]
    met = met[np.concatenate([[True], changed("h") | changed("node")])]
    new = np.concatenate([[True], changed("h")])
    run = np.concatenate([[True], new[1:] | changed("root")])
    place = np.arange(len(met))
    start = np.maximum.accumulate(np.where(new, place, 0))
    partners = np.maximum.accumulate(np.where(run, place, 0)) - start  # those of other roots before it
    ends = np.cumsum(partners)
    at = 0
    while at < len(met):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        n = partners[at:upto]
        j = np.repeat(np.arange(at, upto), n)
        i = start[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        at = upto
        a, b = met["n"][i].astype(np.int64), met["n"][j].astype(np.int64)
        able = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
        able &= np.minimum(a - met["at"][i], b - met["at"][j]) >= similarity / (1 + similarity) * (a + b) - 1e-9
        u, v = met["node"][i[able]], met["node"][j[able]]
        if len(u):
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
            yield np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _rest(rows: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of nodes of different roots that may have the similarity: those whose prefixes, in one order of all elements, share an element."""
    size = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(12, int((1 - similarity) * size) * _MET.itemsize // MET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "prefix", 2 << 20):
            raw = batch.column("prefix").to_pylist()
            elements, n = np.frombuffer(b"".join(raw), "<u8"), np.array([len(x) // 8 for x in raw])
            own = np.zeros(len(elements), _MET)
            own["h"], own["at"] = elements & np.uint64(0xFFFFFFFF), np.arange(len(elements)) - np.repeat(np.cumsum(n) - n, n)
            for c in ("n", "node", "root"):
                own[c] = np.repeat(batch.column(c).to_numpy(), n)
            part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            own, part = own[order], part[order].astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["part", "blob"])
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        while blobs:
            for u, v in _meetings(np.frombuffer(b"".join(blobs.popitem()[1]), _MET), similarity):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        give_back()

    prefixes = rows.filter("prefix is not null").select("node", "n", "prefix").join(broadcast_if_small(roots), "node", "left")
    dealt = prefixes.select("node", "n", "prefix", F.coalesce("root", "node").alias("root")).mapInArrow(deal, "part long, blob binary")
    return dealt.repartition(parts, "part").mapInArrow(meet, "u long, v long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets, sorted."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(len(a) + len(b) - both, 1)


def similar(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid, component) of each row: rows are in one component if links of at least the similarity lead from one to the other.

    Similarity is the exact Jaccard similarity of the multisets of WORDS-word shingles (fewer words: the whole sequence; none: like all texts of no words), rid a
    hash of the text. Texts of equal words are one node. The tries propose a pair at similarity 0.8 with a probability of about 0.95, at 0.85 of 0.995, and their
    forests not all of these; what they propose is verified nearest first, pairs of parts already connected not at all. Then all pairs of different parts that
    share an element of their prefixes are verified in the same way, which leaves no link out.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), _rid(text).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, counts = _common(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in byte_chunks(batches):
            found = []
            for x in texts_of(batch):
                body, hashes = _hashed(x)
                node, n, wide = _wide(body, hashes)
                parity = prefix = None
                if n and node not in seen:  # once in a task
                    seen.add(node)
                    elements = _elements(hashes)
                    parity, prefix = _parity(elements), _prefix(elements, similarity, known, counts)
                found.append((_signed(node), n, wide, parity, prefix))
            cols = list(zip(*found, strict=True))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rid"), *map(pa.array, cols, types)], names=["doc_id", "rid", "node", "n", "print", "parity", "prefix"])
        give_back()

    rows = durable(source.mapInArrow(run, "doc_id long, rid long, node long, n int, print binary, parity binary, prefix binary"), "wide-prints")
    nodes = durable(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", "print", "parity", "rid")]), "nodes")
    links = trie_links(nodes.filter("n > 0").select("node", "n", "print"), nodes.count(), WIDTH, BUDGET, WIDE_SUBTREE, TRIES, FORESTS)
    links = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "proposed")
    near = durable(_near(links, nodes, similarity).filter(F.col("apart") <= APART), "near")
    roots = _verified(near, source, nodes, similarity)
    rest = durable(_rest(rows, nodes, roots, similarity), "rest")
    roots = _verified(durable(_near(rest, nodes, similarity), "near"), source, nodes, similarity, roots)
    classes = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return rows.select("doc_id", "rid", "node").join(classes, "node").select("doc_id", "rid", "component")


def _near(links: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, apart) of the pairs of nodes whose sizes and parities allow the similarity; apart: fingerprint bits that differ."""
    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "print", "parity")])
    whole = links.join(side("u"), "u").join(side("v"), "v").filter(F.least("n_u", "n_v") >= F.lit(similarity) * F.greatest("n_u", "n_v") - 1e-9)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = lambda c, batch=batch: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            apart, differ = (np.bitwise_count(bits(f"{c}_u") ^ bits(f"{c}_v")).sum(1, dtype=np.int32) for c in ("print", "parity"))
            able = differ <= (1 - similarity) / (1 + similarity) * batch.column("both").to_numpy() + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(apart)], names=["u", "v", "apart"]).filter(pa.array(able))

    both = whole.select("u", "v", "print_u", "print_v", "parity_u", "parity_v", (F.col("n_u").cast("long") + F.col("n_v")).alias("both"))
    return both.mapInArrow(distance, "u long, v long, apart int")


def _trees(links: DataFrame) -> DataFrame:
    """(node, root) as graph.components() has them. Tasks of at most LINKS links or so turn theirs to stars; stars of several tasks meet there."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches if batch.num_rows]
        if held:
            ids, at = np.unique(np.concatenate(held, 1), return_inverse=True)
            forest, (u, v) = Forest(len(ids)), at.reshape(2, -1)
            forest.link(u, v)
            off = np.flatnonzero(forest.up != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[forest.up[off]])], names=["node", "root"])

    tasks = 1 + links.count() // LINKS
    stars = durable(links.select("u", "v").repartition(tasks).mapInArrow(join, "node long, root long"), "roots")
    return stars if tasks == 1 else durable(graph.components(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots")


def _verified(near: DataFrame, source: DataFrame, nodes: DataFrame, similarity: float, roots: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """(node, root) of the components that the given ones make with the proposed links (u, v, apart) that hold, as far as these are needed."""
    roots = near.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots
    for turn in range(rounds + 1):
        if not near.head(1):
            break
        chosen = near.select("u", "v")
        if turn < rounds:  # each node's nearest; in the last round all that are left
            both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "apart"))
            best = both.groupBy("u").agg(F.min_by("v", F.struct("apart", "v")).alias("v"))
            chosen = best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        chosen = durable(chosen, "chosen")
        linked = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_holding(chosen, source, nodes, similarity))
        roots = _trees(durable(linked, "linked"))
        if turn == rounds:
            break
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: E731, B023
        near = near.join(chosen, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
        near = durable(near.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "apart"), "near")
    return roots


def _holding(pairs: DataFrame, source: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts have the similarity, by their shingles."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        for batch in byte_chunks(batches):
            out = []
            for t in texts_of(batch):
                words = t.encode().translate(_LOWER).split()
                body = b" ".join(words)
                hashes = _shingles(words, body) if len(words) > WORDS else np.array([xx(body, SEED)], np.uint64)
                out.append(np.sort(hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    one = durable(ends.join(nodes.select("node", "rid"), "node"), "verify")  # a text for each node, of all rows that have its words
    texts = source.join(broadcast_if_small(one.withColumnRenamed("rid", "of")), F.col("rid") == F.col("of")).select("node", "text").dropDuplicates(["node"])
    sets = durable(texts.mapInArrow(shingled, "node long, shingles binary"), "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wide(raw: bytes) -> np.ndarray:
            out = np.zeros((len(raw) // 5, 8), np.uint8)
            out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            return out.view("<u8").ravel()

        for batch in batches:
            ok = [_overlap(wide(a), wide(b)) >= similarity for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(hold, "u long, v long")


def _rid(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of similar(): that with the smallest key (null: after all others), then the smallest hash of its text. Rows that
    repeat an id with another text are rows of their own; of rows equal in id and text one stays. All columns stay as they are."""
    found = durable(similar(docs, similarity, key, text), "similar")
    last = (1 << 63) - 1
    order = F.struct(F.coalesce("doc_id", F.lit(last)).alias("k"), F.col("doc_id").isNull().alias("none"), "rid")
    least = found.groupBy("component").agg(F.min(order).alias("w"), F.count("*").alias("rows_")).filter("rows_ > 1")
    least = durable(least.select("component", F.when(~F.col("w.none"), F.col("w.k")).alias("w_key"), F.col("w.rid").alias("w_rid")), "winners")
    losers = found.join(least, "component").filter(~(F.col("doc_id").eqNullSafe(F.col("w_key")) & (F.col("rid") == F.col("w_rid"))))
    losers = durable(losers.select(F.col("doc_id").alias("__key"), F.col("rid").alias("__rid")).distinct(), "losers")
    twice = durable(found.groupBy("doc_id", "rid").count().filter("count > 1").select(F.col("doc_id").alias("__key"), F.col("rid").alias("__rid")), "repeated")
    on = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (_rid(text) == F.col("__rid"))
    kept = docs.join(broadcast_if_small(losers), on, "left_anti")
    if not twice.head(1):
        return kept
    again = kept.join(broadcast_if_small(twice), on, "left_semi").withColumn("__rid", _rid(text)).dropDuplicates([key, "__rid"]).drop("__rid")
    return kept.join(broadcast_if_small(twice), on, "left_anti").unionByName(again)
