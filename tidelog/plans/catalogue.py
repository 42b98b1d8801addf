"""Named queries over the plain tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cache_trace as C
from ..operators import dedup as D
from ..operators import index as I
from ..operators import merge as M
from ..operators import multicf, ranges, retention, scan, trace, txn
from ..operators import resolve as R
from . import inputs as S
from .registry import QUERIES, SQL, Query, query

__all__ = ["QUERIES", "SQL"]

# ------------------------------------------------------------------ versions and snapshots

def _shown(state: DataFrame) -> DataFrame:
    part = lambda n: F.try_element_at("columns", F.lit(n))
    return state.select("user_key", F.col("value").cast("long").alias("value"), part("").alias("default_column"), part("kind").alias("kind"), "seq")


@query("mvcc_latest", f"WITH {S.FULL_LOG}, {S.resolved_sql()} SELECT * FROM state")
def _(spark, d):
    return _shown(R.resolve(S.full_log(spark, d), merge="sum", has_merges=True, has_ranges=True))


@query("mvcc_snapshot", f"WITH {S.FULL_LOG}, {S.resolved_sql(where='seq <= 600')} SELECT * FROM state")
def _(spark, d):
    return _shown(R.resolve(S.full_log(spark, d), snapshot=600, merge="sum", has_merges=True, has_ranges=True))


@query("mvcc_read_timestamp", f"WITH {S.FULL_LOG}, {S.resolved_sql(where='udt <= 1704844800')} SELECT * FROM state")
def _(spark, d):
    return _shown(R.resolve(S.full_log(spark, d), read_ts=1704844800, merge="sum", has_merges=True, has_ranges=True))


@query("mvcc_puts_only", """WITH p AS (SELECT user_id AS user_key, event_id AS seq, round(value * 100)::BIGINT AS value, event_type FROM events WHERE event_type <> 'view')
SELECT user_key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS r FROM p) WHERE r = 1 AND event_type <> 'error'""")
def _(spark, d):
    e = S.table(spark, d, "events").filter("event_type <> 'view'")  # a log in which nothing merges: its newest entries are a hash aggregate
    log = e.select(F.col("user_id").alias("user_key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return R.resolve(log, has_merges=False).select("user_key", "value", "seq")


@query("history_scan", f"WITH {S.EVENT_LOG} SELECT user_key, seq, op, value, udt FROM log WHERE udt BETWEEN 1704412800 AND 1705276800")
def _(spark, d):
    return R.versions(S.event_log(spark, d), 1704412800, 1705276800).select("user_key", "seq", "op", "value", "udt")


@query("get_with_timestamp", f"WITH {S.FULL_LOG}, {S.resolved_sql()}, u AS (SELECT a.user_key, max(a.udt) AS udt FROM alive a JOIN base b ON a.user_key = b.user_key AND a.seq = b.bseq AND a.op <> 'DELETE' GROUP BY 1) SELECT s.*, u.udt FROM state s LEFT JOIN u USING (user_key) WHERE s.user_key IN (7, 8, 26)")
def _(spark, d):
    out = R.resolve(S.full_log(spark, d), key_pred=F.col("user_key").isin(7, 8, 26), merge="sum", has_merges=True, has_ranges=True)
    return _shown(out).join(out.select("user_key", "udt"), "user_key")


@query("log_tail", f"WITH {S.EVENT_LOG} SELECT seq, user_key, op, value FROM log WHERE seq >= 500")
def _(spark, d):
    return S.event_log(spark, d).filter("seq >= 500").select("seq", "user_key", "op", "value")


@query("log_properties", f"""WITH {S.EVENT_LOG} SELECT cf, count(*) AS n_entries, count(DISTINCT user_key) AS n_keys, sum((op = 'DELETE')::int)::BIGINT AS n_deletes, sum((op = 'MERGE')::int)::BIGINT AS n_merges,
  0::BIGINT AS n_range_deletes, sum(strlen(value::VARCHAR))::BIGINT AS value_bytes, max(seq) AS last_seq FROM log GROUP BY cf""")
def _(spark, d):
    return scan.properties(S.event_log(spark, d))


@query("newest_marks", f"WITH {S.EVENT_LOG} SELECT max(seq) AS last_seq, max(udt) AS newest_udt, min(write_time) AS oldest_write FROM log")
def _(spark, d):
    return S.event_log(spark, d).agg(F.max("seq").alias("last_seq"), F.max("udt").alias("newest_udt"), F.min("write_time").alias("oldest_write"))


# ------------------------------------------------------------------ merges

_BASE = f"""WITH {S.EVENT_LOG}, base AS (SELECT user_key, max(seq) AS bseq FROM log WHERE op <> 'MERGE' GROUP BY 1),
rows_ AS (SELECT l.*, coalesce(b.bseq, -1) AS bseq FROM log l LEFT JOIN base b USING (user_key) WHERE l.seq >= coalesce(b.bseq, -1)),
st AS (SELECT user_key, max(CASE WHEN op = 'PUT' THEN value END) AS bv, max(seq) AS seq, count(*) FILTER (op = 'MERGE') AS n, {{agg}} FROM rows_ GROUP BY 1)
SELECT user_key, {{out}} AS value FROM st WHERE n > 0 OR bv IS NOT NULL"""
_M = "FILTER (op = 'MERGE')"


def _merged(name: str, agg: str, out: str, operator: str | None = None, cast: str | None = None) -> None:
    @query(name, _BASE.format(agg=agg, out=out))
    def _(spark, d):
        out = R.resolve(S.event_log(spark, d), merge=operator or name.removeprefix("merge_"), has_merges=True)
        return out.select("user_key", F.col("value").cast(cast).alias("value") if cast else "value")


_merged("merge_uint64add", f"sum(value) {_M} AS m", "(coalesce(bv, 0) + coalesce(m, 0))::BIGINT", cast="long")
_merged("merge_max", f"max(value) {_M} AS m", "greatest(bv, m)")
_merged("merge_put", f"arg_max(value, seq) {_M} AS m", "coalesce(m, bv)")
_merged("merge_bytesxor", f"bit_xor(value) {_M} AS m", "CASE WHEN n = 0 THEN bv ELSE xor(coalesce(bv, 0), m) END")
_merged("merge_stringappend", f"string_agg(value::VARCHAR, ',' ORDER BY seq) {_M} AS m", "concat_ws(',', bv::VARCHAR, m)")
_merged("merge_sortlist", f"string_agg(value::VARCHAR, ',' ORDER BY value) {_M} AS m", "coalesce(m, bv::VARCHAR)")


@query("merge_snapshots", f"""WITH {S.EVENT_LOG}, snaps(s) AS (VALUES (200), (500), (900)), v AS (SELECT s, l.* FROM log l JOIN snaps ON seq <= s),
base AS (SELECT s, user_key, max(seq) AS bseq FROM v WHERE op <> 'MERGE' GROUP BY 1, 2),
st AS (SELECT v.s, v.user_key, max(CASE WHEN op = 'PUT' THEN value END) AS bv, count(*) FILTER (op = 'MERGE') AS n, sum(value) FILTER (op = 'MERGE') AS m
  FROM v LEFT JOIN base b ON b.s = v.s AND b.user_key = v.user_key WHERE v.seq >= coalesce(bseq, -1) GROUP BY 1, 2)
SELECT s::BIGINT AS snapshot, user_key, (coalesce(bv, 0) + coalesce(m, 0))::BIGINT AS value FROM st WHERE n > 0 OR bv IS NOT NULL""")
def _(spark, d):
    log, out = S.event_log(spark, d), None
    for s in (200, 500, 900):
        one = R.resolve(log, snapshot=s, merge="sum", has_merges=True).select(F.lit(s).cast("long").alias("snapshot"), "user_key", F.col("value").cast("long").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("merge_operands", f"""WITH {S.EVENT_LOG}, base AS (SELECT user_key, max(seq) AS bseq FROM log WHERE op <> 'MERGE' GROUP BY 1)
SELECT l.user_key, string_agg(l.value::VARCHAR, '|' ORDER BY l.seq) AS operands, count(*) AS n FROM log l LEFT JOIN base b USING (user_key)
WHERE l.seq >= coalesce(b.bseq, -1) AND l.op <> 'DELETE' GROUP BY 1""")
def _(spark, d):
    return R.operands(S.event_log(spark, d)).select("user_key", F.array_join(F.col("operands").cast("array<string>"), "|").alias("operands"), "n")


@query("merge_operand_limit", f"""WITH {S.EVENT_LOG}, base AS (SELECT user_key, max(seq) AS bseq FROM log WHERE op <> 'MERGE' GROUP BY 1)
SELECT l.user_key, count(*) AS n, count(*) > 3 AS incomplete FROM log l LEFT JOIN base b USING (user_key) WHERE l.seq >= coalesce(b.bseq, -1) AND l.op <> 'DELETE' GROUP BY 1""")
def _(spark, d):
    return R.operands(S.event_log(spark, d), limit=3).select("user_key", "n", F.col("operands").isNull().alias("incomplete"))


@query("agg_merge_last3", f"""WITH {S.EVENT_LOG} SELECT user_key, string_agg(value::VARCHAR, ',' ORDER BY seq DESC) AS last3
FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS r FROM log WHERE op = 'MERGE') WHERE r <= 3 GROUP BY 1""")
def _(spark, d):
    ops = S.event_log(spark, d).filter("op = 'MERGE'").select("user_key", "seq", F.array("value").alias("value"))
    out = ops.groupBy("user_key").agg(M.REGISTRY["last3"].fold(F.col("value"), F.col("seq"), F.lit(None)).alias("l"))
    return out.select("user_key", F.array_join(F.col("l").cast("array<string>"), ",").alias("last3"))


@query("agg_merge_segments", f"""WITH {S.EVENT_LOG}, ops AS (SELECT user_key, seq, CASE WHEN value % 5 = 0 THEN 'max' WHEN value % 7 = 0 THEN '' ELSE 'sum' END AS func FROM log WHERE op = 'MERGE'),
named AS (SELECT *, CASE WHEN count(nullif(func, '')) OVER (PARTITION BY user_key ORDER BY seq) = 0 THEN coalesce(first_value(nullif(func, '') IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') ELSE func END AS run_func FROM ops),
runs AS (SELECT *, (run_func <> lag(run_func, 1, '') OVER (PARTITION BY user_key ORDER BY seq))::int AS c FROM named)
SELECT user_key, seq, run_func, sum(c) OVER (PARTITION BY user_key ORDER BY seq)::BIGINT AS segment FROM runs""")
def _(spark, d):
    v = F.col("value")
    func = F.when(v % 5 == 0, "max").when(v % 7 == 0, "").otherwise("sum")
    ops = S.event_log(spark, d).filter("op = 'MERGE'").select("user_key", "seq", func.alias("func"))
    return M.segments_of(ops).select("user_key", "seq", "run_func", "segment")


@query("single_delete_violations", f"""WITH {S.EVENT_LOG}, s AS (SELECT user_key, seq, CASE WHEN op = 'DELETE' THEN 'SINGLE_DELETE' ELSE op END AS op FROM log),
p AS (SELECT *, lag(op) OVER w AS earlier, lag(op, 2) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_key ORDER BY seq))
SELECT user_key, seq, earlier FROM p WHERE op = 'SINGLE_DELETE' AND (coalesce(earlier <> 'PUT', false) OR coalesce(before IN ('PUT', 'MERGE'), false))""")
def _(spark, d):
    log = S.event_log(spark, d).withColumn("op", F.when(F.col("op") == "DELETE", "SINGLE_DELETE").otherwise(F.col("op")))
    return R.single_delete_misuse(log).select("user_key", "seq", "earlier")


# ------------------------------------------------------------------ ranges and scans


@query("range_delete", f"WITH {S.TOMBSTONES_SQL} SELECT o_orderkey AS user_key, o_custkey AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.lo <= o.o_orderkey AND o.o_orderkey < rt.hi AND rt.seq > o.o_orderkey)")
def _(spark, d):
    return R.resolve(S.order_log(spark, d), has_merges=False, has_ranges=True).select("user_key", "value")


@query("range_delete_fragmented", f"WITH {S.TOMBSTONES_SQL} SELECT o_orderkey AS user_key, o_custkey AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.lo <= o.o_orderkey AND o.o_orderkey < rt.hi AND rt.seq > o.o_orderkey)")
def _(spark, d):
    log = S.order_log(spark, d)
    points, dead = log.filter("op = 'PUT'"), log.filter("op = 'DELETE_RANGE'")
    return ranges.drop_covered(points, dead, count=ranges.FEW + 1).select("user_key", "value")


def _many(n: int) -> str:
    """n tombstones over the order keys: spans of growing width, at sequence numbers that some keys exceed."""
    return f"rt AS (SELECT lo, lo + 1 + i % 37 AS hi, CASE WHEN i % 3 = 0 THEN lo ELSE lo + i % 50 END AS seq FROM (SELECT i, i * 7919 % (SELECT max(o_orderkey) FROM orders) AS lo FROM range({n}) t(i)))"


def _many_tombstones(spark: SparkSession, d: str, n: int) -> DataFrame:
    top = S.table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    i = F.col("id")
    lo = i * 7919 % F.col("top")
    out = spark.range(n).join(F.broadcast(top))
    return out.select(F.lit("default").alias("cf"), lo.alias("user_key"), F.when(i % 3 == 0, lo).otherwise(lo + i % 50).alias("seq"), F.lit("DELETE_RANGE").alias("op"), F.lit(None).cast("long").alias("value"), (lo + 1 + i % 37).alias("end_key"))


def _range_deletes(n: int) -> None:
    @query(f"range_delete_{n}", f"WITH {_many(n)} SELECT o_orderkey AS user_key, o_custkey AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.lo <= o.o_orderkey AND o.o_orderkey < rt.hi AND rt.seq > o.o_orderkey)")
    def _(spark, d):
        log = S.order_log(spark, d).filter("op = 'PUT'").unionByName(_many_tombstones(spark, d, n))
        return R.resolve(log, has_merges=False, has_ranges=True).select("user_key", "value")

    @query(f"multi_scan_{n}", f"WITH {_many(n)}, r AS (SELECT row_number() OVER (ORDER BY lo, hi, seq) AS range_id, lo, hi FROM (SELECT DISTINCT lo, hi, seq FROM rt)) SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, lo, hi, count(DISTINCT range_id) AS n_ranges FROM orders JOIN r ON o_orderkey >= lo AND o_orderkey < hi GROUP BY lo, hi")
    def _(spark, d):
        dead = _many_tombstones(spark, d, n).select(F.col("user_key").alias("lo"), F.col("end_key").alias("hi"), "seq").distinct()
        ranges_ = dead.withColumn("range_id", F.xxhash64("lo", "hi", "seq"))
        found = ranges.multi_scan(_orders(spark, d), ranges_)
        return found.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum("user_key").alias("keys"), F.countDistinct("range_id").alias("n_ranges")).select("n", "keys", "lo", "hi", "n_ranges")


for _n in (10, 1_000, 10_000):
    _range_deletes(_n)


@query("range_delete_as_of", f"WITH {_many(10_000)} SELECT o_orderkey AS user_key, o_custkey AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.lo <= o.o_orderkey AND o.o_orderkey < rt.hi AND rt.seq > o.o_orderkey)")
def _(spark, d):
    cells = ranges.fragments(_many_tombstones(spark, d, 10_000), by=("cf",))
    found = ranges.as_of(S.order_log(spark, d).filter("op = 'PUT'"), cells, ("cf",), "user_key", rows=5_000)
    return found.filter("coalesce(top_seq <= seq, true)").select("user_key", "value")


@query("range_fragments", f"""WITH {S.TOMBSTONES_SQL}, good AS (SELECT * FROM rt WHERE lo < hi), e AS (SELECT lo AS b FROM good UNION SELECT hi FROM good),
c AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM e) SELECT c.lo, c.hi, max(g.seq) AS top_seq, count(*) AS n FROM c JOIN good g ON g.lo <= c.lo AND g.hi >= c.hi GROUP BY 1, 2""")
def _(spark, d):
    return ranges.fragments(S.order_log(spark, d).filter("op = 'DELETE_RANGE'"))


@query("ignore_range_deletes", "SELECT o_orderkey AS user_key, o_custkey AS value FROM orders")
def _(spark, d):
    return R.resolve(S.order_log(spark, d), has_merges=False, ignore_range_deletes=True).select("user_key", "value")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("user_key"), F.col("o_custkey").alias("value"))


@query("multi_scan", f"WITH {S.RANGES_SQL} SELECT range_id, o_orderkey AS user_key, o_custkey AS value FROM orders JOIN ranges ON o_orderkey >= lo AND (hi IS NULL OR o_orderkey < hi)")
def _(spark, d):
    return ranges.multi_scan(_orders(spark, d), S.scan_ranges(spark)).select("range_id", "user_key", "value")


@query("approximate_size", f"""WITH {S.RANGES_SQL} SELECT range_id, count(*) AS n, sum(strlen(o_orderkey::VARCHAR) + strlen(o_custkey::VARCHAR))::BIGINT AS bytes
FROM orders JOIN ranges ON o_orderkey >= lo AND (hi IS NULL OR o_orderkey < hi) GROUP BY 1""")
def _(spark, d):
    return scan.approximate_size(_orders(spark, d), S.scan_ranges(spark))


_WANTED = ((0, 3), (1, 99), (2, 3), (3, -5), (4, 140))


@query("multi_get", f"WITH k(pos, user_key) AS (VALUES {', '.join(map(str, _WANTED))}) SELECT k.pos, k.user_key, c.c_name AS name, c.c_custkey IS NOT NULL AS found FROM k LEFT JOIN customer c ON c.c_custkey = k.user_key")
def _(spark, d):
    keys = spark.createDataFrame(list(_WANTED), "pos int, user_key long")
    state = S.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"), F.col("c_name").alias("name"))
    return scan.multi_get(state, keys).select("pos", "user_key", "name", "found")


@query("key_may_exist", f"WITH k(pos, user_key) AS (VALUES {', '.join(map(str, _WANTED))}) SELECT pos, user_key FROM k WHERE user_key IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    state = S.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return scan.key_may_exist(spark.createDataFrame(list(_WANTED), "pos int, user_key long"), state)


@query("seek", "SELECT o_orderkey AS user_key, o_custkey AS value FROM orders WHERE o_orderkey >= 500 ORDER BY 1 LIMIT 50")
def _(spark, d):
    return scan.seek(_orders(spark, d), 500, 50)


@query("seek_for_prev", "SELECT o_orderkey AS user_key, o_custkey AS value FROM orders WHERE o_orderkey <= 500 ORDER BY 1 DESC LIMIT 50")
def _(spark, d):
    return scan.seek_for_prev(_orders(spark, d), 500, 50)


@query("range_scan", "SELECT o_orderkey AS user_key, o_custkey AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def _(spark, d):
    return scan.scan(_orders(spark, d), 100, 900)


@query("reverse_scan", "SELECT o_orderkey AS user_key, o_custkey AS value, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders WHERE o_orderkey < 300")
def _(spark, d):
    from pyspark.sql.window import Window

    return scan.scan(_orders(spark, d), None, 300, reverse=True).withColumn("place", F.row_number().over(Window.orderBy(F.col("user_key").desc())).cast("long"))


@query("prefix_scan", "SELECT c_name AS user_key, c_custkey AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def _(spark, d):
    return scan.scan(S.table(spark, d, "customer").select(F.col("c_name").alias("user_key"), F.col("c_custkey").alias("value")), prefix="Customer#00000001")


@query("key_segments", "SELECT p_name AS user_key, p_name[1:4] AS s1, p_name[5:6] AS s2, CASE WHEN length(p_name) >= 12 THEN p_name[1:12] END AS fixed12 FROM part")
def _(spark, d):
    k = F.col("p_name")
    a, b = X.segments(k, 4, 2)
    return S.table(spark, d, "part").select(k.alias("user_key"), a.alias("s1"), b.alias("s2"), X.fixed_prefix(k, 12).alias("fixed12"))


# ------------------------------------------------------------------ column families, indexes, neighbours


@query("coalesce_cf", f"""WITH {S.ENTITIES} SELECT coalesce(a.user_key, f.user_key) AS user_key, a.segment, a.nation, f.orders, coalesce(f.status, a.status) AS status FROM attrs a FULL JOIN figures f USING (user_key)""")
def _(spark, d):
    a, f = S.customer_entities(spark, d)
    out = multicf.coalesce([("attributes", a), ("figures", f)])
    return out.select("user_key", *[F.try_element_at("columns", F.lit(n)).alias(n) for n in ("segment", "nation", "orders", "status")])


@query("attribute_groups", f"""WITH {S.ENTITIES}, g AS (SELECT user_key, 0 AS o, 'attributes=nation:' || nation || ',segment:' || segment || ',status:' || status AS t FROM attrs
UNION ALL SELECT user_key, 1, 'figures=orders:' || orders || ',status:' || status FROM figures) SELECT user_key, string_agg(t, ';' ORDER BY o) AS groups FROM g GROUP BY 1""")
def _(spark, d):
    a, f = S.customer_entities(spark, d)
    out = multicf.attribute_groups([("attributes", a), ("figures", f)])
    cells = lambda g: F.array_join(F.transform(F.sort_array(F.map_entries(g["columns"])), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.select("user_key", F.array_join(F.transform("groups", lambda g: F.concat(g["cf"], F.lit("="), cells(g))), ";").alias("groups"))


@query("secondary_index_lookup", "SELECT c_custkey AS user_key, c_name AS name, c_mktsegment AS index_value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    state = S.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"), F.col("c_name").alias("name"), "c_mktsegment")
    values = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "index_value string")
    return I.lookup(I.build(state, "c_mktsegment"), state, values).select("user_key", "name", "index_value")


@query("secondary_index_maintenance", """WITH a AS (SELECT p_size AS v, p_partkey AS k FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_size + (p_partkey % 2)::INT AS v, p_partkey AS k FROM part WHERE p_partkey % 5 <> 0)
SELECT 'remove' AS action, v AS index_value, k AS primary_key FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'add', v, k FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, d):
    p = S.table(spark, d, "part")
    before = I.build(p.filter("p_partkey % 3 <> 0"), "p_size", "p_partkey")
    after = I.build(p.filter("p_partkey % 5 <> 0").withColumn("p_size", (F.col("p_size") + F.col("p_partkey") % 2).cast("int")), "p_size", "p_partkey")
    return I.maintenance(before, after)


_Q = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0)"


@query("knn_exact", f"""WITH {_Q}, p AS (SELECT query_id, vec_id, {S.DISTANCE('embedding', 'query')} AS distance FROM q, embeddings)
SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10""")
def _(spark, d):
    return I.knn(*S.vectors(spark, d), 10)


@query("knn_ivf", f"""WITH {_Q}, c AS (SELECT vec_id AS list_id, embedding AS centroid FROM embeddings WHERE vec_id < 16),
a AS (SELECT vec_id, embedding, list_id FROM (SELECT vec_id, embedding, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY {S.DISTANCE('embedding', 'centroid')}, list_id) AS r FROM embeddings, c) WHERE r = 1),
p AS (SELECT query_id, query, list_id FROM (SELECT query_id, query, list_id, row_number() OVER (PARTITION BY query_id ORDER BY {S.DISTANCE('query', 'centroid')}, list_id) AS r FROM q, c) WHERE r <= 4)
SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM
(SELECT query_id, vec_id, {S.DISTANCE('embedding', 'query')} AS distance FROM p JOIN a USING (list_id))) WHERE rank <= 10""")
def _(spark, d):
    v, q = S.vectors(spark, d)
    return I.knn_ivf(v, q, v.filter("vec_id < 16").select(F.col("vec_id").alias("list_id"), F.col("embedding").alias("centroid")), 10, 4)


# ------------------------------------------------------------------ compaction and retention

_SNAPS = (200, 500, 900)


@query("compaction_stripes", f"""WITH {S.FULL_LOG}, striped AS (SELECT *, CASE WHEN seq <= 200 THEN 200 WHEN seq <= 500 THEN 500 WHEN seq <= 900 THEN 900 ELSE 9223372036854775807 END::BIGINT AS stripe FROM points),
ts AS (SELECT *, CASE WHEN seq <= 200 THEN 200 WHEN seq <= 500 THEN 500 WHEN seq <= 900 THEN 900 ELSE 9223372036854775807 END::BIGINT AS stripe FROM tomb),
alive AS (SELECT * FROM striped p WHERE NOT EXISTS (SELECT 1 FROM ts t WHERE t.stripe = p.stripe AND t.lo <= p.user_key AND p.user_key < t.hi AND t.seq > p.seq)),
base AS (SELECT user_key, stripe, max(seq) AS bseq FROM alive WHERE op <> 'MERGE' GROUP BY 1, 2),
st AS (SELECT a.user_key, a.stripe, max(a.seq) AS seq, max(CASE WHEN a.seq = b.bseq THEN op END) AS bop, max(CASE WHEN op IN ('PUT', 'PUT_ENTITY') THEN value END) AS bv, count(*) FILTER (op = 'MERGE') AS n,
  sum(value) FILTER (op = 'MERGE') AS m FROM alive a LEFT JOIN base b USING (user_key, stripe) WHERE a.seq >= coalesce(b.bseq, -1) GROUP BY 1, 2),
f AS (SELECT *, stripe > min(stripe) OVER (PARTITION BY user_key) AS older, (coalesce(bv, 0) + coalesce(m, 0))::BIGINT AS v FROM st)
SELECT user_key, seq, CASE WHEN n = 0 OR bop = 'PUT_ENTITY' THEN bop WHEN bop IS NULL AND older THEN 'MERGE' ELSE 'PUT' END AS op, CASE WHEN bop = 'PUT_ENTITY' OR (bop = 'DELETE' AND n = 0) THEN NULL ELSE v END AS value,
  CASE WHEN bop = 'PUT_ENTITY' THEN v::VARCHAR END AS default_column, NULL::BIGINT AS end_key, stripe FROM f WHERE NOT (bop = 'DELETE' AND n = 0 AND NOT older)
UNION ALL SELECT lo, seq, 'DELETE_RANGE', NULL, NULL, hi, stripe FROM ts WHERE stripe > 200""")
def _(spark, d):
    out = retention.compact(S.full_log(spark, d), _SNAPS, merge="sum", has_ranges=True)
    return out.select("user_key", "seq", "op", "value", F.try_element_at("columns", F.lit("")).alias("default_column"), "end_key", "stripe")


@query("compaction_keeps_snapshots", f"WITH {S.FULL_LOG}, {S.resolved_sql(where='seq <= 500')} SELECT * FROM state")
def _(spark, d):
    log = retention.compact(S.full_log(spark, d), _SNAPS, merge="sum", has_ranges=True).drop("stripe")
    return _shown(R.resolve(log, snapshot=500, merge="sum", has_merges=True, has_ranges=True))


@query("ttl_expire", f"WITH {S.EVENT_LOG} SELECT user_key, seq, value FROM log WHERE op = 'PUT' AND NOT (write_time + 864000 < 1706400000)")
def _(spark, d):
    return retention.drop_expired(S.event_log(spark, d).filter("op = 'PUT'"), 864000, 1706400000).select("user_key", "seq", "value")


_FILES = "files AS (SELECT write_time // 86400 AS file_id, max(write_time) AS newest, (count(*) * 100)::BIGINT AS size FROM log GROUP BY 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("write_time div 86400")
    return S.event_log(spark, d).groupBy(day.alias("file_id")).agg(F.max("write_time").alias("newest"), (F.count("*") * 100).alias("size"))


@query("fifo_size_drop", f"WITH {S.EVENT_LOG}, {_FILES} SELECT file_id, newest, size FROM (SELECT *, sum(size) OVER (ORDER BY newest DESC, file_id DESC) AS k FROM files) WHERE k > (SELECT sum(size) * 0.4 FROM files)")
def _(spark, d):
    files = _files(spark, d)
    cap = files.agg(F.sum("size")).first()[0] * 0.4
    return retention.size_drop(files, cap).select("file_id", "newest", "size")


@query("fifo_ttl_drop", f"WITH {S.EVENT_LOG}, {_FILES} SELECT file_id, newest, size FROM files WHERE newest < 1706400000 - 864000")
def _(spark, d):
    return retention.fifo(_files(spark, d), 864000, None, 1706400000).select("file_id", "newest", "size")


@query("history_low", f"""WITH {S.EVENT_LOG}, b AS (SELECT *, row_number() OVER (PARTITION BY user_key, udt < 1705276800 ORDER BY udt DESC, seq DESC) AS r FROM log) SELECT user_key, seq, op, udt FROM b WHERE udt >= 1705276800 OR r = 1""")
def _(spark, d):
    return retention.drop_history_below(S.event_log(spark, d), 1705276800).select("user_key", "seq", "op", "udt")


@query("trim_history", f"WITH {S.EVENT_LOG} SELECT user_key, seq, op FROM log WHERE udt <= 1704844800")
def _(spark, d):
    return retention.trim_history(S.event_log(spark, d), 1704844800).select("user_key", "seq", "op")


@query("clip_family", f"WITH {S.EVENT_LOG} SELECT user_key, seq, op FROM log WHERE user_key >= 20 AND user_key < 60")
def _(spark, d):
    return retention.clip(S.event_log(spark, d), 20, 60).select("user_key", "seq", "op")


@query("compaction_filter", f"WITH {S.EVENT_LOG} SELECT user_key, seq, CASE WHEN value > 5000 THEN 5000 ELSE value END AS value FROM log WHERE op = 'PUT' AND value % 10 <> 0")
def _(spark, d):
    rules = (retention.remove_empty_values, lambda df: df.filter("op = 'PUT' AND value % 10 <> 0"), lambda df: df.withColumn("value", F.least("value", F.lit(5000).cast("long"))))
    return retention.filtered(S.event_log(spark, d), *rules).select("user_key", "seq", "value")


@query("deletion_windows", f"""WITH {S.EVENT_LOG}, w AS (SELECT sum((op = 'DELETE')::int) OVER (PARTITION BY cf ORDER BY user_key, seq DESC ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS near, cf FROM log)
SELECT cf, max(near) >= 40 AS compact FROM w GROUP BY 1""")
def _(spark, d):
    return retention.deletion_windows(S.event_log(spark, d), 100, 40)


@query("storage_tiers", f"WITH {S.EVENT_LOG} SELECT CASE WHEN 1706659200 - write_time < 604800 THEN 'hot' WHEN 1706659200 - write_time < 1209600 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM log GROUP BY 1")
def _(spark, d):
    return S.event_log(spark, d).groupBy(retention.storage_tier(F.lit(1706659200) - F.col("write_time"), 604800, 1209600).alias("tier")).agg(F.count("*").alias("n"))


@query("seqno_to_time", f"""WITH {S.EVENT_LOG}, m AS (SELECT seq, write_time AS time FROM log WHERE seq % 50 = 0) SELECT l.seq, m.time FROM log l ASOF LEFT JOIN m ON l.seq >= m.seq""")
def _(spark, d):
    log = S.event_log(spark, d)
    marks = log.filter("seq % 50 = 0").select("seq", F.col("write_time").alias("time"))
    return retention.seqno_to_time(log.select("seq"), marks).select("seq", "time")


_CELLS = """cells AS (SELECT user_key, seq, CASE WHEN op = 'DELETE' THEN NULL ELSE (value % 4)::INT END AS col, CASE WHEN op = 'DELETE' THEN 'row_tombstone' WHEN value % 11 = 0 THEN 'tombstone' ELSE 'column' END AS kind, udt AS ts, value FROM log)"""


@query("cassandra_row_merge", f"""WITH {S.EVENT_LOG}, {_CELLS}, dead AS (SELECT user_key, max(ts) AS dts FROM cells WHERE kind = 'row_tombstone' GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY user_key, col ORDER BY ts DESC, seq DESC) AS r FROM cells WHERE kind <> 'row_tombstone')
SELECT b.user_key, b.col AS column, b.kind, b.ts, b.value FROM b LEFT JOIN dead USING (user_key) WHERE r = 1 AND (dts IS NULL OR ts > dts)""")
def _(spark, d):
    gone, v = F.col("op") == "DELETE", F.col("value")
    kind = F.when(gone, "row_tombstone").when(v % 11 == 0, "tombstone").otherwise("column")
    cells = S.event_log(spark, d).select("user_key", "seq", F.when(~gone, (v % 4).cast("int")).alias("column"), kind.alias("kind"), F.col("udt").alias("ts"), "value")
    return retention.merge_rows(cells)


# ------------------------------------------------------------------ deduplication

_BIG = "big AS (SELECT *, sha1(value) AS fp, strlen(value)::BIGINT AS size FROM vals WHERE strlen(value) >= 64)"


@query("dedup_index", f"WITH {S.TEXTS}, {_BIG} SELECT fp, count(*) AS refcount, min(seq) AS first_seq, max(size) AS size FROM big GROUP BY 1")
def _(spark, d):
    return D.index(S.texts(spark, d))


@query("dedup_branches", f"WITH {S.TEXTS} SELECT CASE WHEN strlen(value) >= 64 THEN 'large' ELSE 'small' END AS branch, count(*) AS n, sum(strlen(value))::BIGINT AS bytes FROM vals GROUP BY 1")
def _(spark, d):
    return S.texts(spark, d).groupBy(D.branch(F.col("value")).alias("branch")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).cast("long").alias("bytes"))


@query("dedup_stats", f"""WITH {S.TEXTS}, v AS (SELECT CASE WHEN strlen(value) >= 64 THEN sha1(value) END AS fp, strlen(value)::BIGINT AS size FROM vals), g AS (SELECT fp, size, count(*) AS n FROM v GROUP BY 1, 2),
t AS (SELECT sum(n)::BIGINT AS n_ops, coalesce(sum(n) FILTER (fp IS NULL), 0)::BIGINT AS n_small, sum(CASE WHEN fp IS NOT NULL THEN n - 1 ELSE 0 END)::BIGINT AS hits, count(fp) AS misses,
sum(n * size)::BIGINT AS bytes_in, sum(CASE WHEN fp IS NOT NULL THEN size + 35 ELSE n * size END)::BIGINT AS bytes_stored FROM g) SELECT *, bytes_in - bytes_stored AS bytes_saved FROM t""")
def _(spark, d):
    return D.stats(S.texts(spark, d))


_ALIVE = "refs AS (SELECT fp, count(*) AS refcount, count(*) FILTER (seq % 3 <> 0) AS live, max(size) AS size FROM big GROUP BY 1), r AS (SELECT *, CASE WHEN live = 0 THEN size + 35 ELSE 0 END AS garbage FROM refs)"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    values = S.texts(spark, d)
    return D.refcounts_after(values, values.filter("seq % 3 <> 0").select("user_key", "seq"))


@query("dedup_refcount", f"WITH {S.TEXTS}, {_BIG}, {_ALIVE} SELECT fp, refcount, live, size, garbage::BIGINT AS garbage FROM r")
def _(spark, d):
    return _refs(spark, d)


@query("dedup_gc_candidates", f"""WITH {S.TEXTS}, {_BIG}, {_ALIVE}, f AS (SELECT fp[1:1] AS file_id, sum(size + 35)::BIGINT AS total, sum(garbage)::BIGINT AS garbage FROM r GROUP BY 1)
SELECT file_id, total, garbage, round(garbage / total, 6) AS ratio FROM f WHERE garbage >= 0.3 * total""")
def _(spark, d):
    return D.gc_candidates(_refs(spark, d), F.substring("fp", 1, 1), 0.3)


@query("dedup_dereference", f"WITH {S.TEXTS} SELECT user_key, seq, sha1(value) AS digest FROM vals")
def _(spark, d):
    log, unique = D.separate(S.texts(spark, d))
    return D.dereference(log, unique).select("user_key", "seq", F.sha1(F.col("value").cast("binary")).alias("digest"))


@query("offline_dedup_drain", """WITH q AS (SELECT doc_id % 300 AS user_key, doc_id AS seq, text AS value FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS r FROM q)
SELECT sha1(value) AS fp, count(*) AS refcount, min(seq) AS first_seq, max(strlen(value))::BIGINT AS size FROM n WHERE r = 1 AND strlen(value) >= 64 GROUP BY 1""")
def _(spark, d):
    return D.drain(S.table(spark, d, "documents").select((F.col("doc_id") % 300).alias("user_key"), F.col("doc_id").alias("seq"), F.lit("PUT").alias("op"), F.col("text").alias("value")))


# ------------------------------------------------------------------ operation traces


def _t(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(S.op_trace(spark, d))


_TR = f"WITH {S.OP_TRACE} "
_OK = "sum(CASE WHEN type IN (0, 8) AND value_size <= 0 THEN 0 ELSE 1 END)::BIGINT"
query("trace_totals", _TR + f"SELECT type, cf_id, count(*) AS n_ops, count(DISTINCT key) AS n_keys, {_OK} AS n_found FROM trace GROUP BY 1, 2")(_t(trace.totals))
query("trace_key_counts", _TR + "SELECT type, cf_id, key, count(*) AS n, arg_max(value_size, ts) AS value_size FROM trace GROUP BY 1, 2, 3")(_t(trace.key_counts))
_KC = "kc AS (SELECT type, cf_id, key, count(*) AS n FROM trace GROUP BY 1, 2, 3)"
query("trace_access_dist", f"WITH {S.OP_TRACE}, {_KC} SELECT type, cf_id, n AS accesses, count(*) AS n_keys FROM kc GROUP BY 1, 2, 3")(_t(trace.access_distribution))
query("trace_key_sizes", f"""WITH {S.OP_TRACE}, k AS (SELECT DISTINCT type, cf_id, key, length(key::VARCHAR) AS size FROM trace)
SELECT type, cf_id, count(*) AS n_keys, round(avg(size), 6) AS mean_size, round(avg(size * size) - avg(size) * avg(size), 6) AS var_size, quantile_disc(size, 0.5)::INT AS median_size FROM k GROUP BY 1, 2""")(_t(trace.key_size_stats))
query("trace_value_dist", _TR + "SELECT type, cf_id, (floor(value_size / 8) * 8)::BIGINT AS size_from, count(*) AS n FROM trace GROUP BY 1, 2, 3")(_t(trace.value_distribution))
query("trace_qps", _TR + "SELECT type, cf_id, sec, count(*) AS qps FROM timed GROUP BY 1, 2, 3")(_t(trace.qps))
_QPS = "q AS (SELECT type, cf_id, sec, count(*) AS qps FROM timed GROUP BY 1, 2, 3)"
query("trace_qps_summary", f"WITH {S.OP_TRACE}, {_QPS} SELECT type, cf_id, max(qps) AS peak, round(sum(qps) / (max(sec) - min(sec) + 1), 6) AS average FROM q GROUP BY 1, 2")(_t(trace.qps_summary))
query("trace_top_seconds", f"WITH {S.OP_TRACE}, {_QPS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, cf_id ORDER BY qps DESC, sec) AS rank FROM q) WHERE rank <= 5")(_t(lambda t: trace.top_seconds(t, 5)))
query("trace_top_second_prefixes", f"""WITH {S.OP_TRACE}, {_QPS}, b AS (SELECT type, cf_id, sec FROM (SELECT *, row_number() OVER (PARTITION BY type, cf_id ORDER BY qps DESC, sec) AS rank FROM q) WHERE rank <= 5)
SELECT t.type, t.cf_id, t.sec, t.key::VARCHAR[1:1] AS prefix, count(*) AS n FROM timed t JOIN b USING (type, cf_id, sec) GROUP BY 1, 2, 3, 4""".replace("t.key::VARCHAR[1:1]", "substring(t.key::VARCHAR, 1, 1)"))(_t(lambda t: trace.top_second_prefixes(t, 5, X.capped_prefix(F.col("key").cast("string"), 1))))
query("trace_topk", f"WITH {S.OP_TRACE}, {_KC} SELECT type, cf_id, key, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY type, cf_id ORDER BY n DESC, key) AS rank FROM kc) WHERE rank <= 10")(_t(lambda t: trace.top_keys(t, 10)))
query("trace_prefix_cut", _TR + f"""SELECT type, cf_id, substring(key::VARCHAR, 1, 1) AS prefix, count(*) AS n_ops, count(DISTINCT key) AS n_keys, {_OK} AS n_found,
round(count(*) / count(DISTINCT key), 6) AS avg_accesses, round({_OK} / count(*), 6) AS success FROM trace GROUP BY 1, 2, 3""")(_t(lambda t: trace.prefix_cut(t, X.capped_prefix(F.col("key").cast("string"), 1))))
query("trace_correlation", f"""WITH {S.OP_TRACE}, l AS (SELECT *, last_value(CASE WHEN type = 1 THEN ts END IGNORE NULLS) OVER (PARTITION BY cf_id, key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM trace)
SELECT cf_id, 1 AS first_type, 0 AS then_type, count(*) AS n, round(avg(ts - p), 3) AS mean_gap FROM l WHERE type = 0 AND p IS NOT NULL GROUP BY 1""")(_t(lambda t: trace.correlation(t, 1, 0)))
query("trace_whole_key_space", f"WITH {S.OP_TRACE} SELECT c_custkey AS key, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT key, count(*) AS n FROM trace GROUP BY 1) t ON t.key = c_custkey")(
    lambda spark, d: trace.whole_key_space(S.op_trace(spark, d), S.table(spark, d, "customer").select(F.col("c_custkey").alias("key")))
)
query("trace_unique_growth", f"""WITH {S.OP_TRACE}, f AS (SELECT cf_id, key, min(sec) AS sec FROM timed GROUP BY 1, 2), p AS (SELECT cf_id, sec, count(*) AS new_keys FROM f GROUP BY 1, 2)
SELECT *, sum(new_keys) OVER (PARTITION BY cf_id ORDER BY sec)::BIGINT AS total_keys FROM p""")(_t(trace.unique_growth))
query("trace_time_series", _TR + "SELECT type, sec, key FROM timed")(_t(trace.time_series))


@query("latency_percentiles", """WITH v AS (SELECT event_type, round(value * 100)::BIGINT AS us, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 100)::BIGINT) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(us) FILTER (r = floor(0.5 * (n - 1))) AS p50, min(us) FILTER (r = floor(0.99 * (n - 1))) AS p99, min(us) FILTER (r = floor(0.999 * (n - 1))) AS p999, sum(us) / max(n) AS avg FROM v GROUP BY 1""")
def _(spark, d):
    return scan.percentiles(S.table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("us")), ["event_type"], "us")


# ------------------------------------------------------------------ block-cache traces


def _b(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(S.block_trace(spark, d))


_BT = f"WITH {S.BLOCK_TRACE} "
query("cache_summary", _BT + "SELECT cf_name, level, count(*) AS n, count(DISTINCT block_key) AS n_blocks, sum(is_cache_hit::int)::BIGINT AS hits, round(1 - sum(is_cache_hit::int) / count(*), 6) AS miss_ratio FROM trace GROUP BY 1, 2")(_b(lambda t: C.summary(t, ["cf_name", "level"])))
query("cache_caller_pct", _BT + "SELECT caller, cf_name, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY cf_name), 4) AS pct FROM trace GROUP BY 1, 2")(_b(lambda t: C.percentages(t, ["caller", "cf_name"], ["cf_name"])))
_AC = "ac AS (SELECT block_key, count(*) AS n FROM trace GROUP BY 1)"
query("cache_access_buckets", f"WITH {S.BLOCK_TRACE}, {_AC} SELECT CASE WHEN n <= 10 THEN 10 WHEN n <= 25 THEN 25 WHEN n <= 30 THEN 30 END::BIGINT AS upto, count(*) AS n_blocks, sum(n)::BIGINT AS n_accesses FROM ac GROUP BY 1")(_b(lambda t: C.access_buckets(t, (10, 25, 30))))
query("cache_top_blocks", f"WITH {S.BLOCK_TRACE}, {_AC} SELECT block_key, n FROM ac ORDER BY n DESC, block_key LIMIT 20")(_b(lambda t: C.extremes(t, 20)))
query("cache_bottom_blocks", f"WITH {S.BLOCK_TRACE}, {_AC} SELECT block_key, n FROM ac ORDER BY n, block_key LIMIT 20")(_b(lambda t: C.extremes(t, 20, True)))
query("cache_block_sizes", f"""WITH {S.BLOCK_TRACE}, b AS (SELECT DISTINCT block_type, block_key, block_size FROM trace), r AS (SELECT *, row_number() OVER (PARTITION BY block_type ORDER BY block_size) - 1 AS r, count(*) OVER (PARTITION BY block_type) AS n FROM b)
SELECT block_type, max(n) AS n, min(block_size) FILTER (r = floor(0.5 * (n - 1))) AS p50, min(block_size) FILTER (r = floor(0.9 * (n - 1))) AS p90, min(block_size) FILTER (r = floor(0.99 * (n - 1))) AS p99, sum(block_size) / max(n) AS avg FROM r GROUP BY 1""")(_b(C.size_distribution))
query("cache_reuse_interval", _BT + "SELECT block_key, ts, ts - lag(ts) OVER (PARTITION BY block_key ORDER BY ts) AS interval FROM trace")(_b(lambda t: C.reuse_intervals(t).select("block_key", "ts", "interval")))
query("cache_interval_hist", f"""WITH {S.BLOCK_TRACE}, i AS (SELECT day - lag(day) OVER (PARTITION BY block_key ORDER BY ts) AS g FROM trace)
SELECT CASE WHEN g <= 7 THEN 7 WHEN g <= 30 THEN 30 WHEN g <= 90 THEN 90 END::BIGINT AS upto, count(*) AS n FROM i WHERE g IS NOT NULL GROUP BY 1""")(
    _b(lambda t: C.reuse_intervals(t.withColumnRenamed("day", "d_")).withColumn("gap", F.col("d_") - F.lag("d_").over(C.past())).filter("gap is not null").groupBy(F.when(F.col("gap") <= 7, 7).when(F.col("gap") <= 30, 30).when(F.col("gap") <= 90, 90).cast("long").alias("upto")).agg(F.count("*").alias("n")))
)
query("cache_reuse_lifetime", _BT + "SELECT block_key, count(*) AS n, CASE WHEN count(*) > 1 THEN max(ts) - min(ts) END AS lifetime FROM trace GROUP BY 1")(_b(C.lifetimes))
query("cache_timeline", _BT + "SELECT day // 30 * 30 AS slot, caller, count(*) AS n, sum((NOT is_cache_hit)::int)::BIGINT AS misses FROM trace GROUP BY 1, 2")(_b(lambda t: C.timeline(t.withColumn("ts", F.col("day")), 30, ["caller"])))
query("cache_reuse_timeline", f"""WITH {S.BLOCK_TRACE}, e AS (SELECT min(day) AS a, max(day) AS z FROM trace), s AS (SELECT DISTINCT block_key, least((day - a) // 200, greatest((z - a) // 200 - 1, 0))::BIGINT AS w FROM trace, e)
SELECT x.w AS from_window, y.w AS to_window, count(*) AS n FROM s x JOIN s y ON x.block_key = y.block_key AND y.w >= x.w GROUP BY 1, 2""")(_b(lambda t: C.reuse_timeline(t.withColumn("ts", F.col("day")), 200)))
query("cache_skew", f"""WITH {S.BLOCK_TRACE}, {_AC}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, count(*) OVER () AS c, sum(n) OVER () AS t FROM ac), p(top_pct) AS (VALUES (1), (5), (10), (50))
SELECT top_pct, coalesce(sum(n) FILTER (r <= top_pct * c // 100), 0)::BIGINT AS accesses, round(100 * coalesce(sum(n) FILTER (r <= top_pct * c // 100), 0) / max(t), 4) AS pct FROM p, r GROUP BY 1""")(_b(lambda t: C.skewness(t, (1, 5, 10, 50))))
query("cache_spatial_locality", f"""WITH {S.BLOCK_TRACE}, u AS (SELECT block_key, count(DISTINCT referenced_key) AS k FROM trace GROUP BY 1) SELECT least(floor(10 * k / 50) * 10, 100)::BIGINT AS pct_keys, count(*) AS n_blocks FROM u GROUP BY 1""")(_b(lambda t: C.spatial_locality(t, 50)))
query("cache_features", f"""WITH {S.BLOCK_TRACE} SELECT block_key, ts, count(*) OVER (PARTITION BY block_key ORDER BY ts RANGE BETWEEN 300000000000000 PRECEDING AND 1 PRECEDING) AS recent, lead(ts) OVER (PARTITION BY block_key ORDER BY ts) - ts AS next_in FROM trace""")(
    _b(lambda t: C.reuse_features(t, 300000000000000).select("block_key", "ts", "recent", "next_in"))
)
#: Checked against brute-force versions in the tests: reuse distances run over the whole trace; simulators are sequential by nature and run as caches sharded by block.
query("cache_reuse_distance")(_b(C.reuse_distances))
query("cache_miss_curve")(_b(lambda t: C.lru_miss_curve(t, (20_000, 100_000, 400_000))))
query("cache_policies")(_b(lambda t: C.simulate(t, ("lru", "fifo", "mru", "lfu", "gdsize", "opt", "arc", "hyperbolic", "thompson"), (640_000,), 32)))


# ------------------------------------------------------------------ transactions


@query("txn_overlay", f"""WITH {S.FULL_LOG}, b AS (SELECT user_key, seq + 4611686018427387904 AS seq, CASE user_key % 3 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'PUT' ELSE 'MERGE' END AS op, CASE WHEN user_key % 3 > 0 THEN 7::BIGINT END AS value, udt FROM points WHERE seq < 40),
u AS (SELECT * FROM points UNION ALL SELECT * FROM b), {S.resolved_sql(points='u')} SELECT user_key, value, default_column FROM state""")
def _(spark, d):
    log, way = S.full_log(spark, d), F.col("user_key") % 3
    batch = log.filter("seq < 40 and op <> 'DELETE_RANGE'").withColumns({"op": F.when(way == 0, "DELETE").when(way == 1, "PUT").otherwise("MERGE"), "value": F.when(way > 0, F.lit(7).cast("long")), "columns": F.lit(None).cast("map<string,string>")})
    return _shown(R.resolve(txn.overlay(log, batch), merge="sum", has_merges=True, has_ranges=True)).select("user_key", "value", "default_column")


@query("occ_conflicts", f"""WITH {S.EVENT_LOG}, k AS (SELECT user_key % 10 AS txn_id, user_key, min(seq) + 900 AS snapshot FROM log GROUP BY 1, 2), l AS (SELECT user_key, max(seq) AS last_seq FROM log GROUP BY 1)
SELECT txn_id, user_key, last_seq FROM k JOIN l USING (user_key) WHERE last_seq > snapshot""")
def _(spark, d):
    log = S.event_log(spark, d)
    keys = log.groupBy("user_key").agg((F.min("seq") + 900).alias("snapshot")).withColumn("txn_id", F.col("user_key") % 10)
    return txn.conflicts(keys, log)


@query("txn_committed", f"WITH {S.EVENT_LOG} SELECT seq, user_key, op FROM log WHERE user_key % 4 = 0 OR user_key % 3 = 1")
def _(spark, d):
    log = S.event_log(spark, d).withColumn("txn_id", F.when(F.col("user_key") % 4 != 0, F.col("user_key")))
    status = log.filter("txn_id is not null").select("txn_id").distinct().withColumn("status", F.when(F.col("txn_id") % 3 == 1, "committed").otherwise("prepared"))
    return txn.committed(log, status).select("seq", "user_key", "op")


@query("named_snapshots", f"""WITH {S.EVENT_LOG}, t(name, time) AS (VALUES ('early', 1704412800), ('late', 1706140800)) SELECT name, time::BIGINT AS time, max(seq) AS seq FROM t LEFT JOIN log ON write_time <= time GROUP BY 1, 2""")
def _(spark, d):
    times = spark.createDataFrame([("early", 1704412800), ("late", 1706140800)], "name string, time long")
    return txn.named_snapshots(S.event_log(spark, d), times)


from . import stores  # noqa: E402, F401  (registers its own)
