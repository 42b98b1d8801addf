"""Logs, states and traces derived from the plain tables, with the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros():
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of one key for each user: signups and purchases put, clicks and views merge, errors delete."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("MERGE")
    return table(spark, sf_dir, "events").select(
        F.lit("default").alias("cf"),
        F.col("user_id").alias("user_key"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
        F.floor(_micros() / 1_000_000).cast("long").alias("write_time"),
        F.floor(_micros() / 1_000_000).cast("long").alias("udt"),
    )


EVENT_LOG = """log AS (SELECT 'default' AS cf, user_id AS user_key, event_id AS seq,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'MERGE' END AS op,
  round(value * 100)::BIGINT AS value, (epoch_us(ts) // 1000000)::BIGINT AS write_time, (epoch_us(ts) // 1000000)::BIGINT AS udt FROM events)"""

#: Ranges of users deleted at a sequence number and time each.
USER_RANGES = ((10, 30, 300, 1_704_500_000), (25, 60, 700, 1_705_600_000), (100, 120, 950, 1_706_400_000), (130, 130, 5_000, 1_704_067_200))


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log with every kind of operation: signups put entities, purchases put, clicks and views merge, errors delete, and ranges of users go."""
    op = F.when(F.col("event_type") == "signup", "PUT_ENTITY").when(F.col("event_type") == "purchase", "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("MERGE")
    value, at = F.round(F.col("value") * 100).cast("long"), F.floor(_micros() / 1_000_000).cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.lit("default").alias("cf"),
        F.col("user_id").alias("user_key"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.when(op.isin("PUT", "MERGE"), value).alias("value"),
        F.when(op == "PUT_ENTITY", F.create_map(F.lit(""), value.cast("string"), F.lit("kind"), F.col("event_type"))).alias("columns"),
        F.lit(None).cast("long").alias("end_key"),
        at.alias("udt"),
    )
    ranges = spark.createDataFrame([("default", a, s, "DELETE_RANGE", None, None, z, t) for a, z, s, t in USER_RANGES], rows.schema)
    return rows.unionByName(ranges)


FULL_LOG = f"""points AS (SELECT user_id AS user_key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'PUT_ENTITY' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'MERGE' END AS op,
  CASE WHEN event_type <> 'error' THEN round(value * 100)::BIGINT END AS value, (epoch_us(ts) // 1000000)::BIGINT AS udt FROM events),
tomb(lo, hi, seq, udt) AS (VALUES {", ".join(map(str, USER_RANGES))})"""


def resolved_sql(points: str = "points", tomb: str = "tomb", where: str = "true") -> str:
    """CTEs that end in state(user_key, value, default_column, kind, seq): points and tombstones resolved with a sum as the merge."""
    return f"""alive AS (SELECT * FROM {points} p WHERE {where} AND NOT EXISTS (SELECT 1 FROM {tomb} t WHERE {where} AND t.lo <= p.user_key AND p.user_key < t.hi AND t.seq > p.seq)),
base AS (SELECT user_key, max(seq) AS bseq FROM alive WHERE op <> 'MERGE' GROUP BY 1),
st AS (SELECT a.user_key, max(a.seq) AS seq, max(CASE WHEN op IN ('PUT', 'PUT_ENTITY') THEN value END) AS bv, bool_or(op = 'PUT_ENTITY') AS ent, count(*) FILTER (op = 'MERGE') AS n,
  sum(value) FILTER (op = 'MERGE') AS m FROM alive a LEFT JOIN base b USING (user_key) WHERE a.seq >= coalesce(b.bseq, -1) GROUP BY 1),
state AS (SELECT user_key, CASE WHEN NOT ent THEN (coalesce(bv, 0) + coalesce(m, 0))::BIGINT END AS value, CASE WHEN ent THEN ((bv + coalesce(m, 0))::BIGINT)::VARCHAR END AS default_column,
  CASE WHEN ent THEN 'signup' END AS kind, seq FROM st WHERE n > 0 OR bv IS NOT NULL)"""


#: Half-open key ranges over order keys, deleted at a sequence number each; the orders' own numbers are their keys.
TOMBSTONES = ((100, 400, 350), (300, 900, 700), (2_000, 2_600, 10_000_000), (2_500, 2_501, 1), (5_000, 4_000, 9_000_000), (12_000, 30_000, 20_000))
SCAN_RANGES = ((0, 10, 50), (1, 40, 90), (2, 1_000, 1_040), (3, 7_000, None))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = table(spark, sf_dir, "orders").select(
        F.lit("default").alias("cf"), F.col("o_orderkey").alias("user_key"), F.col("o_orderkey").alias("seq"), F.lit("PUT").alias("op"), F.col("o_custkey").alias("value"), F.lit(None).cast("long").alias("end_key")
    )
    rows = [("default", a, s, "DELETE_RANGE", None, z) for a, z, s in TOMBSTONES]
    return puts.unionByName(spark.createDataFrame(rows, "cf string, user_key long, seq long, op string, value long, end_key long"))


TOMBSTONES_SQL = "rt(lo, hi, seq) AS (VALUES " + ", ".join(f"({a}::BIGINT, {z}::BIGINT, {s}::BIGINT)" for a, z, s in TOMBSTONES) + ")"
RANGES_SQL = "ranges(range_id, lo, hi) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {'NULL' if z is None else z}::BIGINT)" for i, a, z in SCAN_RANGES) + ")"


def scan_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCAN_RANGES), "range_id int, lo long, hi long")


def op_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 5).otherwise(6)
    return table(spark, sf_dir, "events").select(_micros().alias("ts"), kind.alias("type"), (F.col("user_id") % 3).cast("int").alias("cf_id"), F.col("user_id").alias("key"), F.floor("value").cast("long").alias("value_size"))


OP_TRACE = """trace AS (SELECT epoch_us(ts) AS ts, CASE event_type WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 5 ELSE 6 END AS type,
  (user_id % 3)::INT AS cf_id, user_id AS key, floor(value)::BIGINT AS value_size FROM events),
timed AS (SELECT *, (floor((ts - min(ts) OVER ()) / 1000000))::BIGINT AS sec FROM trace)"""


def block_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as block accesses: a block for each part, in shipping order."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        (days * 10**13 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"),
        days.alias("day"),
        F.col("l_partkey").alias("block_key"),
        F.col("l_returnflag").alias("block_type"),
        (1000 + F.col("l_partkey") % 7 * 500).cast("long").alias("block_size"),
        F.col("l_returnflag").alias("cf_name"),
        (F.col("l_linenumber") % 3).cast("int").alias("level"),
        F.col("l_linestatus").alias("caller"),
        (F.col("l_orderkey") % 3 != 0).alias("is_cache_hit"),
        (F.col("l_orderkey") % 50).alias("referenced_key"),
    )


BLOCK_TRACE = """trace AS (SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 10000000000000 + l_orderkey * 10 + l_linenumber AS ts,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, l_partkey AS block_key, l_returnflag AS block_type, (1000 + l_partkey % 7 * 500)::BIGINT AS block_size,
  l_returnflag AS cf_name, (l_linenumber % 3)::INT AS level, l_linestatus AS caller, l_orderkey % 3 <> 0 AS is_cache_hit, l_orderkey % 50 AS referenced_key FROM lineitem)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to be deduplicated: documents and conversation turns, each under a key and sequence number of its own."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("user_key"), (F.col("doc_id") * 2).alias("seq"), F.col("text").alias("value"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("user_key"), ((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("seq"), F.col("text").alias("value"))
    return docs.unionByName(turns)


TEXTS = """vals AS (SELECT concat('d', doc_id) AS user_key, doc_id * 2 AS seq, text AS value FROM documents
  UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), (conv_id * 1000 + turn) * 2 + 1, text FROM conversations)"""


def customer_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(attributes, order figures) of each customer as two column families of entities; both have a column 'status'."""
    c = table(spark, sf_dir, "customer")
    attrs = c.select(F.col("c_custkey").alias("user_key"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("status"), F.lit("new")).alias("columns"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    figures = o.select(F.col("o_custkey").alias("user_key"), F.create_map(F.lit("orders"), F.col("n").cast("string"), F.lit("status"), F.col("s")).alias("columns"))
    return attrs, figures


ENTITIES = """attrs AS (SELECT c_custkey AS user_key, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, 'new' AS status FROM customer),
figures AS (SELECT o_custkey AS user_key, count(*)::VARCHAR AS orders, max(o_orderstatus) AS status FROM orders GROUP BY 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all vectors, the queries among them: ids divisible by 100)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v, v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_D = lambda a, b: f"round(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"
DISTANCE = _D
