"""Secondary indexes and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import l2


def build(state: DataFrame, column: str, key: str = "user_key") -> DataFrame:
    """(value, key) entries of the rows that have the column. It is a view of the state, so it can't fall out of step with it."""
    return state.filter(F.col(column).isNotNull()).select(F.col(column).alias("index_value"), F.col(key).alias("primary_key"))


def maintenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, index_value, primary_key) that take one index to another."""
    gone = before.exceptAll(after).withColumn("action", F.lit("remove"))
    new = after.exceptAll(before).withColumn("action", F.lit("add"))
    return gone.unionByName(new).select("action", "index_value", "primary_key")


def lookup(index: DataFrame, state: DataFrame, values: DataFrame, key: str = "user_key") -> DataFrame:
    """The state's rows whose indexed column has one of the values (index_value)."""
    hits = index.join(values, "index_value").withColumnRenamed("primary_key", key)
    return state.join(hits, key)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


#: Vectors and queries that meet at once: a task holds one block of each, and distances for STEP queries.
VECTORS, QUERIES, STEP = 1 << 13, 1 << 12, 256


def _closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of y, rows of x, squared distance) that hold, for each row of y, its k nearest by (distance to 6 digits, row of x), and few others.

    A matrix product rules out what can't be among them, by more than its error and the rounding; the distances left are summed from the first dimension to the last, as l2() does."""
    columns, xx = np.ascontiguousarray(x.T), (x * x).sum(1)
    error = 1e-14 * (x.shape[1] + 8)
    widest, found = xx[np.isfinite(xx)].max(initial=0), []
    for at in range(0, len(y), STEP):
        part = y[at : at + STEP]
        yy = (part * part).sum(1)
        near = yy[:, None] + xx - 2 * (part @ columns)
        if len(x) > k:
            bound = np.partition(near, k - 1, 1)[:, k - 1] + 1.1e-6 + 2 * error * (yy + widest)
            rows, others = np.nonzero(~(near > bound[:, None]))  # NaN stays
        else:
            rows, others = (i.ravel() for i in np.indices(near.shape))
        for cut in range(0, len(rows), 1 << 18):
            # Whole queries would be cut here, which costs no more than a few rows too many.
            r, c = rows[cut : cut + (1 << 18)], others[cut : cut + (1 << 18)]
            total = np.zeros(len(r))
            for i, column in enumerate(columns):
                gap = column[c] - part[r, i]
                total += gap * gap
            order = np.lexsort((c, total, r))  # of equal distances the k first rows of x are enough
            r, c, total = r[order], c[order], total[order]
            same = (r[1:] == r[:-1]) & ((total[1:] == total[:-1]) | np.isnan(total[1:]) & np.isnan(total[:-1]))
            starts = np.concatenate([[True], ~same])
            place = np.arange(len(r)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
            found.append((r[place < k] + at, c[place < k], total[place < k]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _meet(v: pa.Table, q: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, distance) of a block of vectors and one of queries; null where one is null, has null elements or is of another length."""
    v = v.take(pc.sort_indices(v, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))

    def sizes(t: pa.Table, column: str) -> np.ndarray:
        whole = t["whole_"].to_numpy().astype(bool)
        return np.where(whole, pc.fill_null(pc.list_value_length(t[column]), -1).to_numpy(), -1)

    def matrix(t: pa.Table, column: str, rows: np.ndarray, size: int) -> np.ndarray:
        return pc.list_flatten(t[column].take(pa.array(rows))).to_numpy().astype(np.float64).reshape(len(rows), size)

    of_v, of_q = sizes(v, "embedding"), sizes(q, "query")
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
    for size in np.unique(of_q).tolist():
        asked = np.flatnonzero(of_q == size)
        alike = np.flatnonzero(of_v == size) if size >= 0 else np.zeros(0, np.int64)
        unlike = (np.flatnonzero(of_v != size) if size >= 0 else np.arange(len(of_v)))[:k]
        with np.errstate(all="ignore"):
            r, c, d = _closest(matrix(v, "embedding", alike, size), matrix(q, "query", asked, size), k) if len(alike) else (alike, alike, np.zeros(0))
        pairs += [(asked[r], alike[c], d, True), (np.repeat(asked, len(unlike)), np.tile(unlike, len(asked)), np.zeros(len(asked) * len(unlike)), False)]
    r, c, d = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(3))
    known = np.concatenate([np.full(len(p[0]), p[3]) for p in pairs]) if pairs else np.zeros(0, bool)
    return pa.table({"query_id": q["query_id"].take(pa.array(r)), "vec_id": v["vec_id"].take(pa.array(c)), "distance": pa.array(d.astype(np.float64), pa.float64(), mask=~known)})


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, count: int, asked: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vec_id, distance), the k nearest of each query and few others, among the vectors of its `on`: all blocks of vectors meet all blocks of queries, each pair in a task of its own."""
    blocks, groups = max(1, -(-count // (VECTORS * (4 if on else 1)))), max(1, -(-asked // QUERIES))
    whole = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False)).alias("whole_")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    there = F.lit(True)
    for c in on:
        there = there & F.col(c).isNotNull()
    v = vectors.filter(there).select(*on, "vec_id", "embedding", whole("embedding"), part("vec_id", blocks).alias("block_"), upto(groups).alias("group_"))
    q = queries.filter(there).select(*on, "query_id", "query", whole("query"), part("query_id", groups).alias("group_"), upto(blocks).alias("block_"))
    kind = dict(v.dtypes) | dict(q.dtypes)
    keys = (*on, "block_", "group_")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, k), f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, distance double").withColumn("distance", F.round("distance", 6))


def knn(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest rows of vectors (vec_id, embedding) to each query (query_id, query), all compared.

    That is the product of both in time; tasks hold a block of each, however many there are. More than most_queries are an error where it is given."""
    n = queries.count()
    if most_queries is not None and n > most_queries:
        raise ValueError(f"{n} queries; at most {most_queries} were allowed - split them, or use knn_ivf")
    return _ranked(_nearest(vectors, queries, k, vectors.count(), n), k)


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with the list_id of their nearest centroid (list_id, centroid); ties to the lower list_id. Centroids are few by design."""
    scored = vectors.join(F.broadcast(centroids)).withColumn("d_", F.round(l2(F.col("embedding"), F.col("centroid")), 6))
    keep = [c for c in vectors.columns if c != "vec_id"]
    return scored.groupBy("vec_id").agg(F.min_by("list_id", F.struct("d_", "list_id")).alias("list_id"), *[F.first(c).alias(c) for c in keep])


def train(vectors: DataFrame, lists: int, rounds: int = 5, sample: int = 50_000) -> DataFrame:
    """(list_id, centroid) by k-means on at most `sample` vectors, the ones whose ids hash lowest."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), np.float64)
    centres = x[:lists].copy()
    for _ in range(rounds):
        near = np.argmin((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = x[near == i].mean(0)
    spark = vectors.sparkSession
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "list_id int, centroid array<double>")


def knn_ivf(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int) -> DataFrame:
    """Like knn(), but a query meets only the vectors of its `probes` nearest lists; it may get fewer than k."""
    lists = assign(vectors, centroids)
    d = F.round(l2(F.col("query"), F.col("centroid")), 6)
    order = Window.partitionBy("query_id").orderBy("d_", "list_id")
    probe = queries.join(F.broadcast(centroids)).withColumn("d_", d).withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= probes)
    return _ranked(_nearest(lists, probe.select("query_id", "query", "list_id"), k, vectors.count(), queries.count(), ("list_id",)), k)
