"""Reports over a trace of block accesses: (ts, block_key, block_type, block_size, cf_name, level, caller, is_cache_hit, ...), and cache simulators."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written


def past():
    """A block's accesses in order. Made when called: importing this module on a worker must not need a session."""
    return Window.partitionBy("block_key").orderBy("ts")


def summary(trace: DataFrame, by: Sequence[str]) -> DataFrame:
    hits = F.sum(F.col("is_cache_hit").cast("long"))
    return trace.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("block_key").alias("n_blocks"), hits.alias("hits"), F.round(1 - hits / F.count("*"), 6).alias("miss_ratio"))


def percentages(trace: DataFrame, by: Sequence[str], of: Sequence[str] = ()) -> DataFrame:
    """(by.., n, pct): the share of accesses, of each `of` group or of all."""
    per = trace.groupBy(*by).agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*of)), 4))


def access_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("block_key").agg(F.count("*").alias("n"))


def access_buckets(trace: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """(upto, n_blocks, n_accesses): blocks by the first bound at or above their access count; null above all."""
    bucket = F.lit(None).cast("long")
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col("n") <= b, F.lit(b).cast("long")).otherwise(bucket)
    return access_counts(trace).groupBy(bucket.alias("upto")).agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_accesses"))


def extremes(trace: DataFrame, k: int, bottom: bool = False) -> DataFrame:
    order = F.col("n").asc() if bottom else F.col("n").desc()
    return access_counts(trace).orderBy(order, "block_key").limit(k)


def size_distribution(trace: DataFrame, by: Sequence[str] = ("block_type",)) -> DataFrame:
    from .scan import percentiles

    blocks = trace.select(*by, "block_key", "block_size").distinct()
    return percentiles(blocks, by, "block_size", (0.5, 0.9, 0.99))


def reuse_intervals(trace: DataFrame) -> DataFrame:
    """Each access with the time since the block's previous one; null on the first."""
    return trace.withColumn("interval", F.col("ts") - F.lag("ts").over(past()))


def interval_histogram(trace: DataFrame, bounds: Sequence[int]) -> DataFrame:
    bucket = F.lit(None).cast("long")
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col("interval") <= b, F.lit(b).cast("long")).otherwise(bucket)
    return reuse_intervals(trace).filter("interval is not null").groupBy(bucket.alias("upto")).agg(F.count("*").alias("n"))


def lifetimes(trace: DataFrame) -> DataFrame:
    """(block_key, n, lifetime): last access less first; null for one access, which histograms put in their last bucket."""
    out = trace.groupBy("block_key").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("lifetime"))
    return out.withColumn("lifetime", F.when(F.col("n") > 1, F.col("lifetime")))


def timeline(trace: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    slot = (F.floor(F.col("ts") / width) * width).cast("long")
    return trace.groupBy(slot.alias("slot"), *by).agg(F.count("*").alias("n"), F.sum((~F.col("is_cache_hit").cast("boolean")).cast("long")).alias("misses"))


def reuse_timeline(trace: DataFrame, width: int) -> DataFrame:
    """(from_window, to_window, n): distinct blocks of one window seen again in another at or after it. Windows are duration / width, the rest falling in the last."""
    ends = F.broadcast(trace.agg(F.min("ts").alias("a"), F.max("ts").alias("z")))
    last = F.greatest(F.floor((F.col("z") - F.col("a")) / width) - 1, F.lit(0))
    seen = trace.join(ends).select("block_key", F.least(F.floor((F.col("ts") - F.col("a")) / width), last).alias("w")).distinct()
    windows = seen.groupBy("block_key").agg(F.sort_array(F.collect_set("w")).alias("ws"))  # bounded by the number of windows
    pairs = windows.select(F.explode("ws").alias("from_window"), "ws").select("from_window", F.explode(F.filter("ws", lambda x: x >= F.col("from_window"))).alias("to_window"))
    return pairs.groupBy("from_window", "to_window").agg(F.count("*").alias("n"))


def skewness(trace: DataFrame, percents: Sequence[int], label: Column | None = None) -> DataFrame:
    """(top_pct, accesses, pct): accesses held by the top p % of labels, the first p * n / 100 in integer division."""
    label = F.col("block_key") if label is None else label
    counts = trace.groupBy(label.alias("label")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy("c").agg(F.count("*").alias("k"))  # labels with equal counts rank as one step
    w = Window.orderBy(F.col("c").desc())
    ranked = sizes.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy())).withColumn("total", F.sum(F.col("k") * F.col("c")).over(Window.partitionBy()))
    out = ranked.withColumn("top_pct", F.explode(F.array(*map(F.lit, percents)))).withColumn("cut", F.expr("top_pct * n div 100"))
    inside = F.greatest(F.least(F.col("cut") - (F.col("upto") - F.col("k")), F.col("k")), F.lit(0))
    held = out.groupBy("top_pct").agg(F.sum(inside * F.col("c")).alias("accesses"), F.max("total").alias("total"))
    return held.select("top_pct", "accesses", F.round(100 * F.col("accesses") / F.col("total"), 4).alias("pct"))


def spatial_locality(trace: DataFrame, keys_in_block: int) -> DataFrame:
    """(pct_keys, n_blocks): blocks by the share, in tens of percent, of their keys that reads referred to."""
    used = trace.groupBy("block_key").agg(F.countDistinct("referenced_key").alias("k"))
    share = F.least(F.floor(10 * F.col("k") / keys_in_block) * 10, F.lit(100)).cast("long")
    return used.groupBy(share.alias("pct_keys")).agg(F.count("*").alias("n_blocks"))


def key_references(trace: DataFrame, keys_in_block: int, by: Sequence[str] = ("block_type",)) -> DataFrame:
    """(by.., n_blocks, n_refs, avg_keys, most, avg_share): how the reads of blocks spread over their keys: distinct keys referred to, the most references of one key, and the
    share of a block's keys that are referred to at all."""
    refs = trace.groupBy(*by, "block_key", "referenced_key").agg(F.count("*").alias("n"))
    blocks = refs.groupBy(*by, "block_key").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_refs"), F.max("n").alias("most"))
    share = F.least(F.col("n_keys") / keys_in_block, F.lit(1.0))
    return blocks.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.sum("n_refs").alias("n_refs"), F.round(F.avg("n_keys"), 6).alias("avg_keys"), F.max("most").alias("most"), F.round(F.avg(share), 6).alias("avg_share"))


def reuse_features(trace: DataFrame, horizon: int) -> DataFrame:
    """Accesses with the numbers of earlier accesses of their block within the horizon, and the time to the next: what predictors are fitted on."""
    near = past().rangeBetween(-horizon, -1)
    return trace.withColumn("recent", F.count("*").over(near)).withColumn("next_in", F.lead("ts").over(past()) - F.col("ts"))


# ------------------------------------------------------------------ reuse distances over the whole trace

#: Accesses in a slot of the trace, about, and the most slots: the driver holds a table of slots x slots.
SLOT, SLOTS = 1 << 16, 512
#: The end of a block's last interval. It stands for null, with which pandas would read longs as floats.
OPEN = 1 << 62


def _enclosing(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the summed sizes of the earlier rows with a larger end: bit by bit of the ends' ranks, from the top."""
    n, out = len(ends), np.zeros(len(ends), np.int64)
    rank = np.empty(n, np.int64)
    rank[np.argsort(ends, kind="stable")] = np.arange(n)
    order = np.arange(n)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        r = rank[order]
        high = (r >> bit & 1).astype(bool)
        upto = np.concatenate([[0], np.cumsum(np.where(high, sizes[order], 0))])
        low = np.flatnonzero(~high)
        out[order[low]] += upto[low] - upto[r[low] >> (bit + 1) << (bit + 1)]
        order = order[np.argsort(r >> bit, kind="stable")]
    return out


def _within(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, distance) of the accesses of one slot in order. edge has 2 for a block's first access in the slot and 1 for its last. An access whose block's previous one is in the slot
    too has its distance here; a first one has the bytes of the distinct blocks that the slot touched before it."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    prev, following = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    prev[order[1:][again]] = order[:-1][again]
    following[order[:-1][again]] = order[1:][again]
    back = np.flatnonzero(prev >= 0)
    ended = np.zeros(n, np.int64)
    ended[back] = sizes[prev[back]]
    distance = np.cumsum(sizes) - sizes - np.cumsum(ended)
    # Open before the previous access and still: intervals that leave the slot, and those that end in it later.
    inside = following < n
    leaving = np.cumsum(np.where(inside, 0, sizes))
    inner = np.zeros(n, np.int64)
    inner[inside] = leaving[inside] + _enclosing(following[inside], sizes[inside])
    distance[back] -= inner[prev[back]]
    return 2 * (prev < 0) + (following == n), distance


def _slots(trace: DataFrame) -> DataFrame:
    """(block_key, ts, block_size, at, edge, distance): the accesses, cut by (ts, block_key) into slots, each with its place (33 bits below the slot) and what _within says. A slot is a
    task's partition, so what stays inside it is never shuffled again."""
    rows = trace.select("block_key", "ts", "block_size")
    slots = min(SLOTS, max(1, -(-rows.count() // SLOT)))
    rows = rows.repartitionByRange(slots, "ts", "block_key").sortWithinPartitions("ts", "block_key").withColumn("at", F.monotonically_increasing_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            slot = pa.Table.from_batches(held).combine_chunks()
            keys = pc.fill_null(slot["block_key"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            edge, distance = _within(keys, pc.fill_null(slot["block_size"], 0).to_numpy().astype(np.int64))
            slot = slot.append_column("edge", pa.array(edge.astype(np.int32))).append_column("distance", pa.array(distance))
            yield from slot.to_batches(max_chunksize=1 << 16)

    kind = dict(rows.dtypes)
    return written(rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in rows.columns) + ", edge int, distance long"))


def _crossing(slots: DataFrame) -> DataFrame:
    """(start, w, at): the intervals from a block's access to its next in a later slot, with the size it had at the start; `at` is OPEN for its last access of all.
    They come from the slots' edges alone, so no window holds more than two rows of a slot, however hot a block is."""
    block = Window.partitionBy("block_key").orderBy("x")
    edges = slots.filter("edge > 0").select("block_key", (F.shiftleft("at", 2) + F.col("edge")).alias("x"), F.coalesce(F.col("block_size").cast("long"), F.lit(0).cast("long")).alias("w"))
    edges = edges.select("x", "w", F.lag("x").over(block).alias("earlier"), F.lag("w").over(block).alias("held"), F.lead("x").over(block).isNull().alias("last"))
    come = F.when((F.col("x").bitwiseAND(F.lit(2).cast("long")) > 0) & F.col("earlier").isNotNull(), F.struct(F.shiftright("earlier", 2).alias("start"), F.col("held").alias("w"), F.shiftright("x", 2).alias("at")))
    stay = F.when(F.col("last"), F.struct(F.shiftright("x", 2).alias("start"), F.col("w"), F.lit(OPEN).alias("at")))
    return written(edges.select(F.explode(F.array_compact(F.array(come, stay))).alias("e")).select("e.*"))


def reuse_distances(trace: DataFrame) -> DataFrame:
    """(block_key, ts, block_size, distance): bytes of the distinct other blocks of the whole trace touched since the block's previous access; -1 on the first.

    An access whose previous one is in its slot of the trace has its distance from the slot alone. Another ends an interval (p, i) from an earlier slot: its distance is what its slot touched
    before it, and the size of all intervals from earlier slots open at i, less that of those open at p already. The latter are summed in three parts: intervals that start in p's
    slot, by a task for each slot; intervals from earlier slots that end in i's slot, likewise; the others by a table of slot pairs."""
    slots = _slots(trace)
    spans = _crossing(slots)
    a, c = F.shiftright("start", 33).alias("a"), F.shiftright("at", 33).alias("c")
    cells = spans.groupBy(a, c).agg(F.sum("w").alias("w")).collect()
    width = 1 + max((r["a"] for r in cells), default=-1)
    table = np.zeros((width, width + 1), np.int64)
    for r in cells:
        table[r["a"], min(r["c"], width)] = r["w"]
    earlier = np.cumsum(table, 0) - table
    outside = np.cumsum(earlier[:, ::-1], 1)[:, ::-1] - earlier
    begun, ended = table.sum(1), table.sum(0)[:width]
    base = np.cumsum(begun) - begun - np.cumsum(ended) + ended

    def starts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        frame["inner"] = _enclosing(frame["at"].to_numpy(), frame["w"].to_numpy())
        frame["a"] = (frame["start"].to_numpy() >> 33).astype(np.int32)
        return frame[frame["at"] < OPEN][["a", "at", "w", "inner"]]

    def finish(rows: pa.Table, ends: pa.Table) -> pa.Table:
        at, own = rows["at"].to_numpy(), rows["distance"].to_numpy()
        end, w, inner, start = (ends[x].to_numpy() for x in ("at", "w", "inner", "a"))
        order = np.argsort(end)
        end, w, inner, start = end[order], w[order], inner[order], start[order]
        out = np.full(len(at), -1, np.int64)
        if len(end):
            here = int(end[0] >> 33)
            later = np.argsort(start, kind="stable")
            enclosing = np.empty(len(end), np.int64)
            enclosing[later] = _enclosing(end[later], w[later])
            order = np.argsort(at)
            found = order[np.searchsorted(at[order], end)]
            out[found] = own[found] + base[here] - np.cumsum(w) - inner - outside[start, here] - enclosing
        return rows.select(["block_key", "ts", "block_size"]).append_column("distance", pa.array(out))

    kind = dict(trace.dtypes)
    row = f"block_key {kind['block_key']}, ts {kind['ts']}, block_size {kind['block_size']}"
    ends = spans.groupBy(a).applyInPandas(starts, "a int, at long, w long, inner long")
    first = slots.filter("edge >= 2").select("block_key", "ts", "block_size", "at", "distance").groupBy(c).cogroup(ends.groupBy(c)).applyInArrow(finish, f"{row}, distance long")
    return slots.filter("edge < 2").select("block_key", "ts", "block_size", "distance").unionByName(first)


def lru_miss_curve(trace: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """(capacity, n, misses, miss_ratio) of an LRU cache of each capacity in bytes: an access misses on its first turn, and where the reuse distance with its own size exceeds the capacity."""
    rows = reuse_distances(trace).withColumn("capacity", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in capacities])))
    miss = ((F.col("distance") < 0) | (F.col("distance") + F.col("block_size") > F.col("capacity"))).cast("long")
    return rows.groupBy("capacity").agg(F.count("*").alias("n"), F.sum(miss).alias("misses"), F.round(F.avg(miss), 6).alias("miss_ratio"))


# ------------------------------------------------------------------ simulators, one shard of the block space at a time


#: What opt takes for the next access of a block that has none: above all (0, place).
NEVER = (1,)


def _queue(policy: str, capacity: int):
    """Misses of lru, mru or fifo. Like all simulators here it is sent the accesses of a trace in pieces (keys, sizes, following), and gives the misses so far: it holds the cache, not the trace."""
    held: OrderedDict = OrderedDict()
    used = misses = 0
    newest, moves = policy == "mru", policy != "fifo"
    while True:
        keys, sizes, _ = yield misses
        for k, size in zip(keys, sizes, strict=True):
            if k in held:
                if moves:
                    held.move_to_end(k)
                continue
            misses += 1
            if size > capacity:
                continue
            while used + size > capacity:
                used -= held.popitem(last=newest)[1]
            held[k] = size
            used += size


def _scored(policy: str, capacity: int, seed: int = 1):
    """Misses of lfu, gdsize, opt, hyperbolic or random: among blocks of one score the one held longest goes."""
    rng = np.random.default_rng(seed)
    held: dict = {}
    score: dict = {}  # hits, worth or next access
    since: dict = {}
    used = misses = i = 0
    clock = 0.0
    greedy, ahead, hyperbolic, blind = (policy == x for x in ("gdsize", "opt", "hyperbolic", "random"))
    while True:
        keys, sizes, following = yield misses
        for k, size, then in zip(keys, sizes, following if ahead else keys, strict=True):
            i += 1
            if k in held:
                if ahead:
                    score[k] = then
                elif greedy:
                    score[k] = clock + 1 / max(size, 1)
                else:
                    score[k] += 1
                continue
            misses += 1
            if size > capacity:
                continue
            while used + size > capacity:
                if hyperbolic:
                    all_ = list(held)
                    sample = dict.fromkeys(rng.integers(0, len(all_), min(64, len(all_))).tolist())
                    victim = min([all_[j] for j in sample], key=lambda x: score[x] / (i - since[x] + 1))
                elif blind:
                    victim = list(held)[int(rng.integers(0, len(held)))]
                else:
                    victim = (max if ahead else min)(score, key=score.__getitem__)
                    if greedy:
                        clock = score[victim]
                used -= held.pop(victim)
                del score[victim]
                if hyperbolic:
                    del since[victim]
            held[k] = size
            score[k] = then if ahead else clock + 1 / max(size, 1) if greedy else 1
            if hyperbolic:
                since[k] = i
            used += size


def _arc(capacity: int):
    """Misses of an adaptive replacement cache: a recent and a frequent list, and ghosts of both that move the border between them."""
    recent, frequent, ghost_r, ghost_f = OrderedDict(), OrderedDict(), OrderedDict(), OrderedDict()
    border, misses, recent_b, frequent_b, ghost_rb, ghost_fb = 0.0, 0, 0, 0, 0, 0  # bytes of each list
    while True:
        keys, sizes, _ = yield misses
        for k, size in zip(keys, sizes, strict=True):
            if k in recent:
                frequent[k] = held = recent.pop(k)
                recent_b -= held
                frequent_b += held
                continue
            if k in frequent:
                frequent.move_to_end(k)
                continue
            misses += 1
            if size > capacity:
                continue
            again = k in ghost_r or k in ghost_f
            if k in ghost_r:
                border = min(float(capacity), border + size * max(1.0, ghost_fb / max(ghost_rb, 1)))
                ghost_rb -= ghost_r.pop(k)
            elif k in ghost_f:
                border = max(0.0, border - size * max(1.0, ghost_rb / max(ghost_fb, 1)))
                ghost_fb -= ghost_f.pop(k)
            while recent_b + frequent_b + size > capacity:
                if recent and (recent_b > border or not frequent):
                    gone, held = recent.popitem(last=False)
                    recent_b -= held
                    ghost_r[gone] = held
                    ghost_rb += held
                    while ghost_rb > capacity:
                        ghost_rb -= ghost_r.popitem(last=False)[1]
                else:
                    gone, held = frequent.popitem(last=False)
                    frequent_b -= held
                    ghost_f[gone] = held
                    ghost_fb += held
                    while ghost_fb > capacity:
                        ghost_fb -= ghost_f.popitem(last=False)[1]
            if again:
                frequent[k] = size
                frequent_b += size
            else:
                recent[k] = size
                recent_b += size


def _thompson(capacity: int, arms: tuple[str, ...] = ("lru", "mru", "lfu"), window: int = 200, seed: int = 1):
    """Misses where, window by window, Thompson sampling picks the policy whose past windows hit best; the blocks held stay from window to window."""
    if set(arms) - {"lru", "mru", "lfu"}:
        raise ValueError(f"arms are lru, mru and lfu, not {arms}")
    rng = np.random.default_rng(seed)
    wins, losses = dict.fromkeys(arms, 1.0), dict.fromkeys(arms, 1.0)
    held: OrderedDict = OrderedDict()  # the latest access at the end
    used = misses = i = 0
    arm = arms[0]
    while True:
        keys, sizes, _ = yield misses
        for k, size in zip(keys, sizes, strict=True):
            if i % window == 0:
                arm = max(arms, key=lambda a: rng.beta(wins[a], losses[a]))
            i += 1
            if k in held:
                held[k][1] += 1
                held.move_to_end(k)
                wins[arm] += 1
                continue
            misses += 1
            losses[arm] += 1
            if size > capacity:
                continue
            while used + size > capacity:
                victim = next(iter(held)) if arm == "lru" else next(reversed(held)) if arm == "mru" else min(held, key=lambda x: held[x][1])
                used -= held.pop(victim)[0]
            held[k] = [size, 1]
            used += size


def _simulator(policy: str, capacity: int, seed: int = 1):
    """A simulator that awaits its first piece: lru, mru, fifo, lfu, hyperbolic, gdsize, random, opt, arc, thompson."""
    if policy in ("lru", "mru", "fifo"):
        out = _queue(policy, capacity)
    elif policy in ("lfu", "hyperbolic", "gdsize", "random", "opt"):
        out = _scored(policy, capacity, seed)
    elif policy in ("arc", "thompson"):
        out = (_arc if policy == "arc" else _thompson)(capacity)
    else:
        raise ValueError(f"no policy named {policy!r}")
    next(out)
    return out


def _simulate(policy: str, keys: list, sizes: list, capacity: int, seed: int = 1) -> int:
    """Misses of one policy over a trace in memory."""
    following: list[tuple] = []
    if policy == "opt":
        nxt: dict = {}
        following = [NEVER] * len(keys)
        for i in range(len(keys) - 1, -1, -1):
            following[i] = nxt.get(keys[i], NEVER)
            nxt[keys[i]] = (0, i)
    return _simulator(policy, capacity, seed).send((keys, sizes, following))


def _bandit(keys: list, sizes: list, capacity: int, arms: tuple[str, ...] = ("lru", "mru", "lfu"), window: int = 200, seed: int = 1) -> int:
    """Misses of the Thompson policy over a trace in memory."""
    steps = _thompson(capacity, arms, window, seed)
    next(steps)
    return steps.send((keys, sizes, ()))


def _shards(jobs: Sequence[tuple[str, int]], shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs all jobs at once over batches of (shard_, block_key, block_size, next_) in the order of their shards and accesses: of a trace it holds the batch at hand."""
    schema = pa.schema([("policy", pa.string()), ("capacity", pa.int64()), ("n", pa.int64()), ("misses", pa.int64())])

    def ended(n: int, misses: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[p for p, _ in jobs], [c for _, c in jobs], [n] * len(jobs), misses], schema.types, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, misses, steps = None, 0, [], []
        for batch in batches:
            shard = batch.column("shard_").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                keys, sizes = piece.column("block_key").to_pylist(), piece.column("block_size").to_pylist()
                following = [NEVER if t is None else (0, t, k) for t, k in zip(piece.column("next_").to_pylist(), keys, strict=True)] if "next_" in batch.schema.names else ()
                if at != shard[a]:
                    if at is not None:
                        yield ended(n, misses)
                    at, n, steps = shard[a], 0, [_simulator(p, c // shards) for p, c in jobs]
                n += b - a
                misses = [s.send((keys, sizes, following)) for s in steps]
        if at is not None:
            yield ended(n, misses)

    return run


def simulate(trace: DataFrame, policies: Sequence[str], capacities: Sequence[int], shards: int = 1, custom: Callable | None = None) -> DataFrame:
    """(policy, capacity, n, misses, miss_ratio). The block space is cut into `shards` caches of capacity / shards each, which run in parallel, each over its accesses in order as
    they stream by. `custom` takes the place of the simulators: (policy, keys, sizes, capacity) to misses; it gets all accesses of a shard at once, in memory."""
    jobs = [(p, int(c)) for p in policies for c in capacities]
    rows = trace.select("ts", "block_key", "block_size", F.pmod(F.xxhash64("block_key"), F.lit(shards)).cast("int").alias("shard_"))
    if custom is None:
        for p, c in jobs:
            _simulator(p, c)  # an unknown policy is an error here rather than in a task
        rows = rows.repartitionById(shards, "shard_") if shards > 1 else rows.repartition(1)
        if "opt" in policies:
            rows = rows.withColumn("next_", F.lead("ts").over(Window.partitionBy("shard_", "block_key").orderBy(F.col("ts").asc_nulls_last())))
        rows = rows.sortWithinPartitions("shard_", F.col("ts").asc_nulls_last(), F.col("block_key").asc_nulls_last())
        out = rows.drop("ts").mapInArrow(_shards(jobs, shards), "policy string, capacity long, n long, misses long")
    else:

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["ts", "block_key"], kind="stable")
            policy, capacity = frame["policy"].iloc[0], int(frame["capacity"].iloc[0])
            return pd.DataFrame({"policy": [policy], "capacity": [capacity], "n": [len(frame)], "misses": [custom(policy, frame["block_key"].tolist(), frame["block_size"].tolist(), capacity // shards)]})

        job = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(c).cast("long").alias("capacity")) for p, c in jobs])).alias("job")
        out = rows.select("*", job).select("ts", "block_key", "block_size", "shard_", "job.*").groupBy("shard_", "policy", "capacity").applyInPandas(run, "policy string, capacity long, n long, misses long")
    return out.groupBy("policy", "capacity").agg(F.sum("n").alias("n"), F.sum("misses").alias("misses")).withColumn("miss_ratio", F.round(F.col("misses") / F.col("n"), 6))
