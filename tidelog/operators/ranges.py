"""Range tombstones and multi-range scans: the joins with inequalities.

Few ranges are broadcast. Many are cut into disjoint fragments, each with its highest sequence number; a key then meets at most one fragment, found by
binary search where the fragments are few enough to be sent to the tasks, else by an as-of step over keys and fragments ranged together. Neither
side is ever compared in full.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written

#: Ranges that a nested-loop join may broadcast.
FEW = 1000
#: Cells or ranges that the tasks get as sorted arrays (some MB).
MOST = 200_000


def _cuts(bounds: DataFrame, column: str, buckets: int) -> list:
    """At most `buckets` values in order, from a fixed number of rows: those whose hash is smallest."""
    rows = bounds.select(column).distinct().orderBy(F.xxhash64(column), column).limit(16 * buckets).collect()
    values = sorted(r[0] for r in rows)
    return values[:: max(1, -(-len(values) // buckets))]


def _bucket(column: Column, cuts: list) -> Column:
    """How many cuts stand at or below the column."""
    return sum(((column >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def _sweep(lo: list, hi: list, seq: list) -> list[tuple]:
    """(from, to, highest seq, ranges) of the disjoint cells between the ends of ranges, in order; only cells that a range covers."""
    begins = sorted(zip(lo, hi, seq, strict=True), key=lambda r: r[0])
    ends = sorted(hi)
    edges = sorted({*lo, *hi})
    heap, out, i, j = [], [], 0, 0
    for a, z in zip(edges, edges[1:], strict=False):
        while i < len(begins) and begins[i][0] == a:
            heapq.heappush(heap, (-begins[i][2], i, begins[i][1]))
            i += 1
        while ends[j] <= a:
            j += 1
        while heap and heap[0][2] <= a:
            heapq.heappop(heap)
        if i > j:
            out.append((a, z, -heap[0][0], i - j))
    return out


def fragments(ranges: DataFrame, lo: str = "user_key", hi: str = "end_key", seq: str = "seq", by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Disjoint (by.., lo, hi, top_seq, n) that together cover what the ranges [lo, hi) cover; n ranges lie over each, the highest with top_seq.

    Ranges go to every bucket of the key space that they reach and are cut to it; a sweep with a heap goes over each bucket. Buckets are cut
    at ends of ranges, so they add no cells. Empty and reversed ranges cover nothing."""
    real = ranges.filter(F.col(lo) < F.col(hi)).select(*by, F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(seq).cast("long").alias("seq"))
    cuts = _cuts(real, "lo", buckets or max(8, min(256, real.count() // 10_000)))
    spread = real.withColumn("bucket_", F.explode(F.sequence(_bucket(F.col("lo"), cuts), _bucket(F.col("hi"), cuts))))
    kinds = dict(real.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"lo {kinds['lo']}", f"hi {kinds['hi']}", "top_seq long", "n long"])
    names = [*by, "lo", "hi", "top_seq", "n"]

    def sweep(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["bucket_"].iloc[0])
        own = [frame[b].iloc[0] for b in by]
        los, his = frame["lo"].tolist(), frame["hi"].tolist()
        if at > 0:
            los = [max(x, cuts[at - 1]) for x in los]
        if at < len(cuts):
            his = [min(x, cuts[at]) for x in his]
        rows = [r for r in zip(los, his, frame["seq"].tolist(), strict=True) if r[0] < r[1]]
        cells = _sweep(*map(list, zip(*rows, strict=True))) if rows else []
        return pd.DataFrame([(*own, *c) for c in cells], columns=names)

    return spread.groupBy(*by, "bucket_").applyInPandas(sweep, schema)


def drop_covered(points: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ("cf",), key: str = "user_key", seq: str = "seq", count: int | None = None) -> DataFrame:
    """points not covered by a range with a strictly higher sequence number; begin is inclusive, end exclusive."""
    r = ranges.select(*[F.col(b).alias(f"r_{b}") for b in by], F.col("user_key").alias("r_lo"), F.col("end_key").alias("r_hi"), F.col("seq").alias("r_seq"))
    n = r.count() if count is None else count
    if n == 0:
        return points
    if n <= FEW:
        on = (F.col("r_lo") <= F.col(key)) & (F.col(key) < F.col("r_hi")) & (F.col("r_seq") > F.col(seq))
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"r_{b}"))
        return points.join(F.broadcast(r), on, "left_anti")
    cells = written(fragments(ranges, by=by), "cells")
    if cells.count() <= MOST:
        top = _lookup(cells, by, key, "top_seq")
        return points.filter(~F.coalesce(top > F.col(seq), F.lit(False)))
    return as_of(points, cells, by, key).filter(~F.coalesce(F.col("top_seq") > F.col(seq), F.lit(False))).drop("lo", "hi", "top_seq", "n")


def _lookup(cells: DataFrame, by: tuple[str, ...], key: str, value: str) -> Column:
    """`value`, a long, of the disjoint cell [lo, hi) that holds the key, else null: at most MOST cells go to the tasks as sorted arrays, where each
    batch of keys is searched at once."""
    kinds = dict(cells.dtypes)
    if not kinds["lo"].endswith("int"):  # text and binary compare by bytes in both worlds; numbers as longs
        kind = object
    else:
        kind = np.int64
    tables: dict[tuple, tuple] = {}
    for r in cells.select(*by, "lo", "hi", F.col(value).cast("long").alias("v")).collect():
        tables.setdefault(tuple(r[b] for b in by), []).append((r["lo"], r["hi"], r["v"]))
    ready = {}
    for g, own in tables.items():
        own.sort(key=lambda x: x[0])
        lo, hi, v = zip(*own, strict=True)
        ready[g] = np.array(lo, kind), np.array(hi, kind), np.array(v, np.int64)
    sent = cells.sparkSession.sparkContext.broadcast(ready)

    @F.pandas_udf("long")
    def find(keys: pd.Series, *groups: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), np.int64)
        found = np.zeros(len(keys), bool)
        known = keys.notna().to_numpy()
        own = pd.Series(list(zip(*groups, strict=True)) if groups else [()] * len(keys))
        for g, (lo, hi, v) in sent.value.items():
            rows = np.flatnonzero(known & (own == g).to_numpy()) if groups else np.flatnonzero(known)
            if len(rows):
                k = keys.to_numpy()[rows].astype(kind)
                at = np.searchsorted(lo, k, "right") - 1
                inside = (at >= 0) & (k < hi[np.maximum(at, 0)])
                out[rows[inside]] = v[at[inside]]
                found[rows[inside]] = True
        return pd.Series(out, dtype="Int64").where(pd.Series(found))

    return find(F.col(key), *[F.col(b) for b in by])


def as_of(points: DataFrame, cells: DataFrame, by: tuple[str, ...], key: str, rows: int = 1_000_000) -> DataFrame:
    """points with the disjoint cell [lo, hi) that holds their key, if any, for any number of cells.

    Points and cells are ranged together by key, about `rows` in a part, so that parts follow the points and not the cells; equal keys may
    fall to several parts. Within a part the last cell that begins at or before a point is carried forward; what enters a part is the last cell of the parts before it,
    one row for each part and family."""
    kinds = dict(cells.dtypes)
    names = points.columns
    cell = "struct<lo:%s,hi:%s,top_seq:bigint,n:bigint>" % (kinds["lo"], kinds["hi"])
    p = points.withColumn("at_", F.col(key).cast(kinds["lo"])).withColumn("kind_", F.lit(1)).withColumn("cell_", F.lit(None).cast(cell))
    c = cells.select(*by, F.col("lo").alias("at_"), F.lit(0).alias("kind_"), F.struct("lo", "hi", F.col("top_seq").cast("long").alias("top_seq"), F.col("n").cast("long").alias("n")).alias("cell_"))
    both = p.unionByName(c, allowMissingColumns=True)
    parts = max(1, min(100_000, -(-points.count() // rows)))
    order = [*by, "at_", "kind_"]
    both = both.withColumn("salt_", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "salt_")
    both = written(both.withColumn("part_", F.spark_partition_id()), "as-of")
    last = both.filter("kind_ = 0").groupBy(*by, "part_").agg(F.max_by("cell_", "at_").alias("last_"))
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    marks = both.select(*by, "part_").distinct().join(last, [*by, "part_"], "left")
    enter = marks.withColumn("enter_", F.last("last_", ignorenulls=True).over(before)).select(*by, "part_", "enter_")
    w = Window.partitionBy(*by, "part_").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("found_", F.last("cell_", ignorenulls=True).over(w)).filter("kind_ = 1").join(enter, [*by, "part_"], "left")
    out = out.withColumn("found_", F.coalesce("found_", "enter_"))
    inside = F.col("at_") < F.col("found_.hi")
    return out.select(*names, *[F.when(inside, F.col(f"found_.{x}")).alias(x) for x in ("lo", "hi", "top_seq", "n")])


def multi_scan(state: DataFrame, ranges: DataFrame, key: str = "user_key") -> DataFrame:
    """Rows of state within each [lo, hi) of ranges (range_id, lo, hi); a null hi is open. A row within several ranges comes once for each.

    Few ranges are broadcast. More, in blocks of at most MOST, stand on the leaves of a binary tree over the sorted bounds: a range is
    the at most 2 * log2 nodes that make it up, a key has log2 ancestors, and the two meet by node. So the join is an equi-join whose
    output is the result, however the ranges overlap."""
    n = ranges.count()
    if n <= FEW:
        on: Column = (F.col(key) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(key) < F.col("hi")))
        return state.join(F.broadcast(ranges), on)
    blocks = -(-n // MOST)
    out = None
    ranges = written(ranges.withColumn("block_", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "scan-ranges")
    for b in range(blocks):
        one = _tree_scan(state, ranges.filter(F.col("block_") == b).drop("block_"), key)
        out = one if out is None else out.unionByName(one)
    return out


def _tree_scan(state: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    rows = ranges.select("lo", "hi").distinct().collect()  # at most MOST
    bounds = sorted({r["lo"] for r in rows} | {r["hi"] for r in rows if r["hi"] is not None})
    kind = np.int64 if dict(ranges.dtypes)["lo"].endswith("int") else object
    sent = state.sparkSession.sparkContext.broadcast(np.array(bounds, kind))
    depth = max(1, (len(bounds)).bit_length())  # leaf i + 1 holds the keys from bound i on, leaf 0 those below all

    @F.pandas_udf("array<long>")
    def nodes(lo: pd.Series, hi: pd.Series) -> pd.Series:
        """The canonical nodes, numbered as in a heap, of the leaves from lo's to the one before hi's."""
        out = []
        table = sent.value
        for a, z in zip(lo, hi, strict=True):
            i = int(np.searchsorted(table, a, "left")) + 1 + (1 << depth)
            j = (1 << depth + 1) if z is None or z != z else int(np.searchsorted(table, kind(z) if kind is np.int64 else z, "left")) + 1 + (1 << depth)
            own = []
            while i < j:
                if i & 1:
                    own.append(i)
                    i += 1
                if j & 1:
                    j -= 1
                    own.append(j)
                i, j = i >> 1, j >> 1
            out.append(own)
        return pd.Series(out)

    @F.pandas_udf("long")
    def leaf(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), np.int64)
        out[known] = np.searchsorted(sent.value, keys.to_numpy()[known].astype(kind), "right") + (1 << depth)
        return pd.Series(out, dtype="Int64").where(pd.Series(known))

    cut = ranges.select("*", F.explode(nodes("lo", "hi")).alias("node_"))
    used = written(cut, "range-nodes")
    few = used.select("node_").distinct()
    climb = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.call_function("shiftright", F.col("leaf_"), k))
    placed = state.withColumn("leaf_", leaf(F.col(key))).filter("leaf_ is not null")
    placed = placed.withColumn("node_", F.explode(climb)).drop("leaf_")
    if few.count() <= 2 * MOST:
        placed = placed.join(F.broadcast(few), "node_", "left_semi")
    return placed.join(used, "node_").drop("node_")
