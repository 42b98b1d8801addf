"""Benchmark decontamination with DataFrame functions only.

A window has as many words as the benchmark item it is held against; a text with fewer is one window. Windows are fingerprinted with SimHash and meet
the items' fingerprints in a multi-index: 64 bits in BLOCKS blocks, of which by the pigeonhole rule one at least differs in no more than
radius // BLOCKS bits where the whole differs in no more than the radius. Items stand in it under all such neighbours of their blocks, windows under their
own, so two unrelated fingerprints meet with a probability of about 0.2. What meets within the radius is verified by exact weighted Jaccard
similarity, a shingle's weight being its count.

Not every window is fingerprinted: those that can't reach the similarity are ruled out before by the shingles they share with the item (similarity s of two windows of
m shingles needs ceil(2sm / (1+s)) shared ones, a shorter window s * m), which loses none.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, let

SHINGLE, SIMILARITY = 5, 0.8
#: Windows at similarity 0.8 differ in about 10 of 64 bits, 3 of standard deviation: 17 keeps 99 in 100 of these, and nearly all above.
RADIUS, BLOCKS = 17, 6


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(tokens: Column, k: int | Column = SHINGLE) -> Column:
    """The 64-bit hash of every k words in a row, repeats included; empty below k words."""
    k = F.lit(k) if isinstance(k, int) else k

    def hashes(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, every).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, hashes)


def simhash(hashes: Column) -> Column:
    """A bit is 1 where over half of the hashes have it."""

    def bit(w: Column, b: Column) -> Column:
        ones = F.aggregate(w, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)))
        return F.when(ones * 2 > F.size(w), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return let(hashes, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(bit(w, b))))


def _blocks(fp: Column, blocks: int, flips: int = 0) -> Column:
    """(index, value) of the blocks of bits, with all values that differ from one in at most `flips` bits."""

    def block(i: int, own: Column, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(width), k)]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).alias("i"), own.bitwiseXOR(m).alias("v")))

    out, at = [], 0
    for i in range(blocks):
        width = 64 // blocks + (i < 64 % blocks)
        out.append(block(i, F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")), width))
        at += width
    return F.concat(*out)


def _shared(m: Column, similarity: float) -> Column:
    return F.ceil(F.lit(2 * similarity / (1 + similarity)) * m - 1e-9).cast("int")


def _overlap(a: Column, b: Column) -> Column:
    """Shingles in common, each as often as the rarer side has it."""
    both = F.array_intersect(a, b)
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    exact = F.aggregate(both, F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(both)).when(F.size(F.array_distinct(b)) == F.size(b), F.size(both)).otherwise(exact)


def _rid(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _leaks(docs: DataFrame, bench: DataFrame, k: int, similarity: float, radius: int, blocks: int, text: str) -> DataFrame:
    """(rid, item_id, start, n_words, hamming, similarity) of texts, by the hash of the whole text, that hold an item: the best window of each."""
    toks = bench.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(k)))
    items = toks.select("item_id", "n", "k", F.monotonically_increasing_id().alias("item_row"), shingle_hashes(F.col("w"), F.col("k")).alias("item")).withColumn("m", F.size("item"))
    items = durable(items.withColumn("item_fp", simhash(F.col("item"))), "items")
    seeds = durable(items.select(F.explode(F.array_distinct("item")).alias("h"), "item_row", "n", "k", "m"), "seeds")
    # Items shorter than k words have shingles of their whole length: a pass for each such length that there is.
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect()) or [k]

    source = docs.select(_rid(text).alias("rid"), F.col(text).alias("text"))
    hits = None

    def shingled(size: int) -> Column:
        return let(words(F.col("text")), lambda w: F.struct((F.size(w) - size + 1).alias("t"), shingle_hashes(w, size).alias("all")))

    for size in lengths:
        spots = source.select("rid", shingled(size).alias("x"))
        spots = spots.select("rid", "x.t", F.posexplode("x.all").alias("pos", "h"))
        one = spots.join(broadcast_if_small(seeds.filter(F.col("k") == size)), "h").groupBy("rid", "item_row", "n", "k", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.min("t").alias("t"))
        hits = one if hits is None else hits.unionByName(one)
    least = F.ceil(F.lit(similarity) * F.col("m") - 1e-9).cast("int")
    need = F.when(F.col("t") < F.col("m"), least).otherwise(_shared(F.col("m"), similarity))
    hits = hits.withColumn("need", need).filter(F.size("at") >= F.col("need"))
    # A window of m shingles holds `need` hits only if it spans hits j .. j+need-1.
    spans = F.transform(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda j: F.struct(F.get("at", j - 1).alias("a"), F.get("at", j + F.col("need") - 2).alias("z")))
    spans = F.filter(spans, lambda s: s["z"] - s["a"] < F.col("m"))
    starts = F.transform(spans, lambda s: F.sequence(F.greatest(s["z"] - F.col("m") + 1, F.lit(0)), s["a"]))
    starts = hits.select("rid", "n", "k", F.explode(F.array_distinct(F.flatten(starts))).alias("start"))
    wanted = durable(starts.groupBy("rid").agg(F.collect_set(F.struct("start", "n", "k")).alias("wanted")), "wanted").withColumnRenamed("rid", "at_rid")

    near = source.join(broadcast_if_small(wanted, most=50_000), F.col("rid") == F.col("at_rid")).dropDuplicates(["rid"])
    near = near.select("rid", words(F.col("text")).alias("w"), F.explode("wanted").alias("x"))
    window = shingle_hashes(F.slice("w", F.col("x.start") + 1, F.col("x.n")), F.col("x.k"))
    windows = near.select("rid", "x.start", "x.n", "x.k", window.alias("window"))
    full, size = F.col("n") - F.col("k") + 1, F.size("window")
    whole = (F.col("start") == 0) & (size < full) & (size >= F.lit(similarity) * full - 1e-9)
    windows = durable(windows.filter((size == full) | whole).withColumn("fp", simhash(F.col("window"))).withColumn("place", F.monotonically_increasing_id()), "windows")

    left = windows.select("place", "n", "fp", F.explode(_blocks(F.col("fp"), blocks)).alias("block"))
    right = items.select("item_row", "n", "item_fp", F.explode(_blocks(F.col("item_fp"), blocks, radius // blocks)).alias("block"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = left.join(broadcast_if_small(durable(right, "item-blocks")), ["n", "block"]).withColumn("hamming", apart).filter(F.col("hamming") <= radius)
    found = durable(found.select("place", "item_row", "hamming").distinct(), "candidates")
    pairs = windows.drop("n").join(found, "place").join(broadcast_if_small(items.select("item_row", "item_id", "item", "m"), most=20_000), "item_row")
    o = _overlap(F.col("window"), F.col("item"))
    pairs = pairs.withColumn("o", o).withColumn("similarity", F.col("o") / (F.col("m") + F.size("window") - F.col("o"))).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), (F.size("window") + F.col("k") - 1).alias("n"))).alias("b")
    return pairs.groupBy("rid", "item_id").agg(best)


def find_leaks(docs: DataFrame, bench: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): for each document and item, the best window at or above the similarity.

    start is the window's first word, from 0; ties go to the higher similarity, fewer differing bits, then the earlier start. Items of fewer than k
    words have one shingle, all their words; null or empty texts match nothing. Rows that repeat a doc_id are held against the items each, and
    their best window counts; a null doc_id is a document id like others. Items that repeat an item_id count as one, with its best window. Empty tables: empty result.
    Other columns are not read.
    """
    leaks = durable(_leaks(docs, bench, k, similarity, radius, blocks, text), "leaks").withColumnRenamed("rid", "leak_rid")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _rid(text).alias("rid"))
    best = rows.join(broadcast_if_small(leaks), F.col("rid") == F.col("leak_rid")).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.h")).alias("hamming"), F.round("b.similarity", 6).alias("similarity"))


def drop_leaks(docs: DataFrame, bench: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, text: str = "text") -> DataFrame:
    """docs without the rows in whose text find_leaks() finds an item; other rows of the same id, or without one, stay."""
    leaks = durable(_leaks(docs, bench, k, similarity, radius, blocks, text).select(F.col("rid").alias("__leak")).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), _rid(text) == F.col("__leak"), "left_anti")
