"""Named queries that go through a store in the shared folder, and those over encodings, folds and transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cache_trace as C
from ..operators import dedup as D
from ..operators import merge as M
from ..operators import multicf, retention, scan
from ..operators import resolve as R
from ..sources.store import Store
from ..streaming import tail
from ..tables import numbered, shared_dir
from . import inputs as S
from .catalogue import _shown
from .registry import query


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _operations(spark: SparkSession, d: str) -> DataFrame:
    """events as operations on string keys, merges as appended texts."""
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("MERGE")
    return S.table(spark, d, "events").select("event_id", "ts", kind.alias("op"), F.format_string("k%05d", "user_id").alias("user_key"), F.when(kind != "DELETE", F.col("event_type")).alias("value"))


_OPERATIONS = """ops AS (SELECT row_number() OVER (ORDER BY ts) AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'MERGE' END AS op,
  printf('k%05d', user_id) AS user_key, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events),
base AS (SELECT user_key, max(seq) AS bseq FROM ops WHERE op <> 'MERGE' GROUP BY 1),
texts AS (SELECT o.user_key, max(seq) AS seq, string_agg(value, ',' ORDER BY seq) AS value FROM ops o LEFT JOIN base b USING (user_key) WHERE o.seq >= coalesce(b.bseq, -1) AND op <> 'DELETE' GROUP BY 1)"""


def _store(spark: SparkSession, d: str) -> Store:
    store = Store(spark, _place(spark, "store"))
    store.bulk(_operations(spark, d), "ts")
    return store


@query("bulk_numbering", f"WITH {_OPERATIONS} SELECT seq, op, user_key, value FROM ops")
def _(spark, d):
    return _store(spark, d).log().select("seq", "op", "user_key", "value")


@query("store_state", f"WITH {_OPERATIONS} SELECT user_key, value, seq FROM texts")
def _(spark, d):
    return _store(spark, d).state(merge="stringappend").select("user_key", "value", "seq")


@query("backup_restore", f"WITH {_OPERATIONS} SELECT user_key, value, seq FROM texts")
def _(spark, d):
    where = _place(spark, "backup")
    _store(spark, d).backup(where)
    return Store(spark, where).restore(_place(spark, "restored")).state(merge="stringappend").select("user_key", "value", "seq")


@query("repaired_store", f"WITH {_OPERATIONS} SELECT user_key, value, seq FROM texts")
def _(spark, d):
    store = _store(spark, d)
    store._append(store.log().filter("seq % 7 = 0"))  # rows written twice
    return store.repair(_place(spark, "repaired")).state(merge="stringappend").select("user_key", "value", "seq")


@query("dump_undump", f"WITH {_OPERATIONS} SELECT user_key, value, row_number() OVER (ORDER BY seq) AS seq FROM texts")
def _(spark, d):
    where = _place(spark, "dump")
    _store(spark, d).dump(where, merge="stringappend")
    out = Store(spark, _place(spark, "undumped"))
    out.undump(where)
    return out.state().select("user_key", "value", "seq")


@query("follower_state", f"WITH {_OPERATIONS} SELECT user_key, value, seq FROM texts")
def _(spark, d):
    store = Store(spark, _place(spark, "primary"))
    where, mark = _place(spark, "follower"), _place(spark, "progress")
    rows = _operations(spark, d)
    for part in ("event_id % 1000 < 400", "event_id % 1000 >= 400"):  # two loads, each followed up
        store.bulk(rows.filter(part), "ts")
        tail.catch_up(tail.tail(spark, store.path), where, mark).awaitTermination()
    return _in_time_order(spark, d, tail.follower_log(spark, where))


def _in_time_order(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
    """The log's entries under the numbers that one load in the order of time gives, resolved."""
    own = numbered(_operations(spark, d).withColumn("part", (F.col("event_id") % 1000 >= 400).cast("int")), "ts").withColumnRenamed("number", "in_time")
    places = numbered(own, "part", "ts").select("in_time", F.col("number").alias("seq"))
    return R.resolve(log.join(places, "seq").withColumn("seq", F.col("in_time")).drop("in_time"), merge="stringappend").select("user_key", "value", "seq")


@query("put_all_get_all", "SELECT concat('d', doc_id) AS user_key, true AS same FROM documents")
def _(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("at"), F.concat(F.lit("d"), "doc_id").alias("user_key"), F.col("text").alias("value"))
    return Store(spark, _place(spark, "replayed")).replay(docs)


@query("ingested_files", "SELECT printf('p%d', p_partkey) AS user_key, p_name AS value, 1::BIGINT AS seq FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT printf('p%d', p_partkey), 'behind', 0 FROM part WHERE p_partkey % 2 = 1")
def _(spark, d):
    part = S.table(spark, d, "part").select(F.format_string("p%d", "p_partkey").alias("user_key"), F.col("p_name").alias("value"), "p_partkey")
    store = Store(spark, _place(spark, "ingested"))
    store.ingest(part.filter("p_partkey % 2 = 0").drop("p_partkey"))
    store.ingest(part.select("user_key", F.lit("behind").alias("value")), behind=True)
    return store.state().select("user_key", "value", "seq")


@query("clip_with_ranges", f"WITH {S.FULL_LOG}, {S.resolved_sql()} SELECT * FROM state WHERE user_key >= 20 AND user_key < 110")
def _(spark, d):
    return _shown(R.resolve(retention.clip(S.full_log(spark, d), 20, 110), merge="sum", has_merges=True, has_ranges=True))


@query("range_dropped", f"WITH {S.FULL_LOG}, {S.resolved_sql()} SELECT * FROM state WHERE NOT (user_key >= 20 AND user_key < 50)")
def _(spark, d):
    return _shown(R.resolve(retention.cut_out(S.full_log(spark, d), 20, 50), merge="sum", has_merges=True, has_ranges=True))


@query("family_dropped", "SELECT cf, count(*) AS n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS cf FROM events) WHERE cf <> 'b' GROUP BY 1")
def _(spark, d):
    store = Store(spark, _place(spark, "families"))
    cf = F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").otherwise("c")
    rows = S.table(spark, d, "events").select(cf.alias("cf"), F.col("user_id").cast("string").alias("user_key"), "ts", F.lit("PUT").alias("op"), F.lit("v").alias("value"))
    store.bulk(rows, "ts")
    return store.drop_family("b", _place(spark, "rest")).log().groupBy("cf").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ entities and files


@query("get_entity", f"WITH {S.FULL_LOG}, {S.resolved_sql()} SELECT user_key, coalesce(default_column, value::VARCHAR) AS unnamed, kind, coalesce(default_column, value::VARCHAR) AS plain FROM state")
def _(spark, d):
    state = R.resolve(S.full_log(spark, d), merge="sum", has_merges=True, has_ranges=True).withColumn("value", F.col("value").cast("string"))
    part = lambda n: F.try_element_at("columns", F.lit(n))
    whole = scan.get_entity(state).select("user_key", part("").alias("unnamed"), part("kind").alias("kind"))
    return whole.join(scan.default_column(state).select("user_key", F.col("value").alias("plain")), "user_key")


@query("split_attribute_groups", "SELECT c_custkey AS user_key, 'attributes' AS cf, 3 AS n FROM customer UNION ALL SELECT o_custkey, 'figures', 2 FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(spark, d):
    a, f = S.customer_entities(spark, d)
    return multicf.split_groups(multicf.attribute_groups([("attributes", a), ("figures", f)])).select("user_key", "cf", F.size("columns").alias("n"))


@query("segment_filter", "WITH f AS (SELECT o_orderkey // 1000 AS file_id, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n FROM orders GROUP BY 1) SELECT file_id, n FROM f WHERE lo <= 40 AND hi >= 35")
def _(spark, d):
    files = S.table(spark, d, "orders").withColumn("file_id", F.expr("o_orderkey div 1000"))
    return scan.may_hold(scan.segment_ranges(files, "file_id", F.col("o_custkey")), 35, 40).select("file_id", "n")


@query("level_scores", """WITH f AS (SELECT CASE WHEN o_orderkey % 1000 < 3 THEN 0 WHEN o_orderkey % 10 < 2 THEN 1 ELSE 2 END AS level, o_custkey AS size FROM orders), p AS (SELECT level, count(*) AS n, sum(size)::BIGINT AS size FROM f GROUP BY 1)
SELECT level, n, size, CASE WHEN level = 0 THEN 4.0 ELSE 1000.0 * pow(10.0, level - 1) END::DOUBLE AS target, round(CASE WHEN level = 0 THEN n / 4 ELSE size / (1000.0 * pow(10.0, level - 1)) END, 6) AS score FROM p""")
def _(spark, d):
    k = F.col("o_orderkey")
    files = S.table(spark, d, "orders").select(F.when(k % 1000 < 3, 0).when(k % 10 < 2, 1).otherwise(2).alias("level"), F.col("o_custkey").alias("size"))
    return retention.level_scores(files, 1000, 10)


@query("universal_runs", """WITH r AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 0 WHEN o_orderkey % 50 = 1 THEN 1 WHEN o_orderkey % 10 = 2 THEN 2 ELSE 3 END AS run, count(*) AS size FROM orders GROUP BY 1),
w AS (SELECT *, coalesce(sum(size) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS newer, max(run) OVER () AS m FROM r)
SELECT run, size, newer, run = m AND newer * 100 > size * 10 AS amplified, newer > 0 AND size * 100 <= newer * 101 AS joins FROM w""")
def _(spark, d):
    k = F.col("o_orderkey")
    run = F.when(k % 100 == 0, 0).when(k % 50 == 1, 1).when(k % 10 == 2, 2).otherwise(3)
    return retention.universal_runs(S.table(spark, d, "orders").groupBy(run.alias("run")).agg(F.count("*").alias("size")), 10)


@query("ttl_merge", f"""WITH {S.EVENT_LOG}, live AS (SELECT * FROM log WHERE NOT (write_time + 864000 < 1706400000)), base AS (SELECT user_key, max(seq) AS bseq FROM live WHERE op <> 'MERGE' GROUP BY 1),
st AS (SELECT l.user_key, max(CASE WHEN op = 'PUT' THEN value END) AS bv, max(l.seq) AS seq, count(*) FILTER (op = 'MERGE') AS n, sum(value) FILTER (op = 'MERGE') AS m FROM live l LEFT JOIN base b USING (user_key) WHERE l.seq >= coalesce(b.bseq, -1) GROUP BY 1),
w AS (SELECT user_key, max(write_time) AS write_time FROM live GROUP BY 1) SELECT user_key, (coalesce(bv, 0) + coalesce(m, 0))::BIGINT AS value, seq, write_time FROM st JOIN w USING (user_key) WHERE n > 0 OR bv IS NOT NULL""")
def _(spark, d):
    return retention.ttl_merge(S.event_log(spark, d), 864000, 1706400000, "sum").select("user_key", F.col("value").cast("long").alias("value"), "seq", "write_time")


# ------------------------------------------------------------------ folds over bytes and changing functions

_BIG = "SELECT user_id AS user_key, event_id AS seq, (round(value * 100)::UBIGINT * 200000000000000::UBIGINT)::HUGEINT % 18446744073709551616 AS v FROM events"


@query("merge_counter_bytes", f"""WITH o AS ({_BIG}), s AS (SELECT user_key, (sum(v) % 18446744073709551616)::UBIGINT AS t FROM o GROUP BY 1), h AS (SELECT user_key, printf('%016x', t) AS x FROM s)
SELECT user_key, upper(concat(x[15:16], x[13:14], x[11:12], x[9:10], x[7:8], x[5:6], x[3:4], x[1:2])) AS counter FROM h""")
def _(spark, d):
    number = (F.round(F.col("value") * 100).cast("decimal(28,0)") * F.lit("200000000000000").cast("decimal(16,0)")).cast("decimal(38,0)") % F.lit(str(1 << 64)).cast("decimal(38,0)")
    stored = S.table(spark, d, "events").select(F.col("user_id").alias("user_key"), F.col("event_id").alias("seq"), X.counter_bytes(number.cast("decimal(20,0)")).alias("raw"))
    out = stored.groupBy("user_key").agg(M.REGISTRY["uint64add"].fold(X.counter(F.col("raw")), F.col("seq"), F.lit(None).cast("decimal(20,0)")).alias("t"))
    return out.select("user_key", F.hex(X.counter_bytes(F.col("t").cast("decimal(20,0)"))).alias("counter"))


@query("merge_xor_bytes", """WITH o AS (SELECT user_id AS user_key, sha1(event_id::VARCHAR)[1:2 * (event_id % 20)::INT] AS x FROM events), b AS (SELECT user_key, i, ('0x' || x[2 * i - 1:2 * i])::INT AS v FROM o, unnest(generate_series(1, length(x) // 2)) t(i)),
c AS (SELECT user_key, i, bit_xor(v) AS v FROM b GROUP BY 1, 2) SELECT k.user_key, coalesce(string_agg(upper(printf('%02x', v)), '' ORDER BY i), '') AS value FROM (SELECT DISTINCT user_key FROM o) k LEFT JOIN c USING (user_key) GROUP BY 1""")
def _(spark, d):
    digits = F.sha1(F.col("event_id").cast("string").cast("binary"))
    ops = S.table(spark, d, "events").select(F.col("user_id").alias("user_key"), F.unhex(F.substring(digits, F.lit(1), (2 * (F.col("event_id") % 20)).cast("int"))).alias("value"))
    return M.bytes_xor(ops).select("user_key", F.hex("value").alias("value"))


@query("merge_max_bytes", f"WITH {S.EVENT_LOG} SELECT user_key, max(value::VARCHAR) AS value FROM log WHERE op <> 'DELETE' GROUP BY 1")
def _(spark, d):
    log = S.event_log(spark, d).filter("op <> 'DELETE'").select("user_key", "seq", F.col("value").cast("string").cast("binary").alias("value"))
    return log.groupBy("user_key").agg(M.REGISTRY["max"].fold(F.col("value"), F.col("seq"), F.lit(None).cast("binary")).cast("string").alias("value"))


@query("agg_merge_fold", f"""WITH {S.EVENT_LOG}, ops AS (SELECT user_key, seq, value, CASE WHEN seq % 1000 < 150 THEN '' WHEN value % 5 = 0 THEN 'max' WHEN value % 11 = 0 THEN 'min' ELSE 'sum' END AS func FROM log WHERE op = 'MERGE'),
named AS (SELECT *, CASE WHEN count(nullif(func, '')) OVER (PARTITION BY user_key ORDER BY seq) = 0 THEN coalesce(first_value(nullif(func, '') IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') ELSE func END AS f FROM ops),
l AS (SELECT user_key, list({{'f': f, 'v': value}} ORDER BY seq) AS l, count(*) AS n_items, bool_or(f = '') AS bad FROM named GROUP BY 1),
r AS (SELECT user_key, n_items, bad, list_reduce(l, lambda a, x: {{'f': x.f, 'v': CASE x.f WHEN 'sum' THEN a.v + x.v WHEN 'max' THEN greatest(a.v, x.v) ELSE least(a.v, x.v) END}}) AS e FROM l)
SELECT user_key, CASE WHEN bad THEN 'kErrorFuncName' ELSE e.f END AS func, CASE WHEN NOT bad THEN e.v END AS value, n_items FROM r""")
def _(spark, d):
    v = F.col("value")
    func = F.when(F.col("seq") % 1000 < 150, "").when(v % 5 == 0, "max").when(v % 11 == 0, "min").otherwise("sum")
    return M.fold_segments(S.event_log(spark, d).filter("op = 'MERGE'").select("user_key", "seq", "value", func.alias("func")))


@query("content_index_changes", """WITH c AS (SELECT user_id AS fp, event_id AS seq, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'inc' WHEN 'purchase' THEN 'retarget' WHEN 'error' THEN 'dec' ELSE CASE WHEN event_id % 50 = 0 THEN 'evict' ELSE 'dec' END END AS change, event_id * 10 AS location FROM events),
k AS (SELECT *, coalesce(max(CASE WHEN change = 'evict' THEN seq END) OVER (PARTITION BY fp), -1) AS cut FROM c), r AS (SELECT *, sum(CASE WHEN change IN ('insert', 'inc') THEN 1 WHEN change = 'dec' THEN -1 ELSE 0 END) OVER (PARTITION BY fp ORDER BY seq) AS s FROM k WHERE seq > cut)
SELECT fp, (arg_max(s, seq) - least(min(s), 0))::BIGINT AS refcount, arg_min(location, seq) FILTER (change = 'insert') AS first_location,
  coalesce(arg_max(location, seq) FILTER (change = 'retarget'), arg_min(location, seq) FILTER (change = 'insert')) AS location FROM r GROUP BY 1""")
def _(spark, d):
    t, i = F.col("event_type"), F.col("event_id")
    change = F.when(t == "signup", "insert").when(t == "click", "inc").when(t == "purchase", "retarget").when(t == "error", "dec").otherwise(F.when(i % 50 == 0, "evict").otherwise("dec"))
    return D.apply_changes(S.table(spark, d, "events").select(F.col("user_id").alias("fp"), i.alias("seq"), change.alias("change"), (i * 10).alias("location")))


@query("lru_victims", "SELECT user_id AS fp, max(event_id) AS stamp FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def _(spark, d):
    return D.victims(S.table(spark, d, "events").groupBy(F.col("user_id").alias("fp")).agg(F.max("event_id").alias("stamp")), 5)


# ------------------------------------------------------------------ encodings


@query("encodings", """SELECT event_id, event_id * 256 + user_id % 7 AS packed, event_id AS seq, user_id % 7 AS kind, upper(printf('%016x', event_id)) AS big_endian,
  CASE WHEN event_id < 128 THEN upper(printf('%02x', event_id)) ELSE upper(printf('%02x', event_id % 128 + 128)) || CASE WHEN event_id < 16384 THEN upper(printf('%02x', event_id // 128)) ELSE upper(printf('%02x', event_id // 128 % 128 + 128) || printf('%02x', event_id // 16384)) END END AS varint FROM events""")
def _(spark, d):
    i, kind = F.col("event_id"), (F.col("user_id") % 7)
    packed = X.packed_seq(i, kind)
    seq, back = X.unpacked_seq(packed)
    return S.table(spark, d, "events").select("event_id", packed.alias("packed"), seq.alias("seq"), back.alias("kind"), F.hex(X.big_endian(i)).alias("big_endian"), X.varint(i).alias("varint"))


@query("codec_round_trip", "SELECT codec, count(*) AS n, count(*) AS same FROM documents, (VALUES ('none'), ('zlib'), ('bzip2'), ('zstd'), ('snappy'), ('lz4')) c(codec) GROUP BY 1")
def _(spark, d):
    docs = S.table(spark, d, "documents").repartition(F.xxhash64("doc_id", "text"))  # few row groups would be few tasks of much work
    docs, raw = docs.select(F.col("text").cast("binary").alias("raw")), F.col("raw")
    same = docs.select(*[X.decompressed(X.compressed(raw, c), c).eqNullSafe(raw).cast("long").alias(c) for c in X.CODECS])
    sums = same.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in X.CODECS]).filter("n > 0")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("codec"), F.col("n"), F.col(c).alias("same")) for c in X.CODECS]))
    return sums.select(each.alias("e")).select("e.*")


@query("masked_checksums", "SELECT doc_id, true AS same, true AS other FROM documents")
def _(spark, d):
    crc = X.crc32c(F.col("text").cast("binary"))
    rows = S.table(spark, d, "documents").select("doc_id", crc.alias("crc"))
    return rows.select("doc_id", (X.unmasked(X.masked(F.col("crc"))) == F.col("crc")).alias("same"), (X.masked(F.col("crc")) != F.col("crc")).alias("other"))


# ------------------------------------------------------------------ block references


@query("cache_key_references", f"""WITH {S.BLOCK_TRACE}, r AS (SELECT block_type, block_key, referenced_key, count(*) AS n FROM trace GROUP BY 1, 2, 3), b AS (SELECT block_type, block_key, count(*) AS n_keys, sum(n)::BIGINT AS n_refs, max(n) AS most FROM r GROUP BY 1, 2)
SELECT block_type, count(*) AS n_blocks, sum(n_refs)::BIGINT AS n_refs, round(avg(n_keys), 6) AS avg_keys, max(most) AS most, round(avg(least(n_keys / 50, 1.0)), 6) AS avg_share FROM b GROUP BY 1""")
def _(spark, d):
    return C.key_references(S.block_trace(spark, d), 50)
