"""Queries over maps, sequences, queues, logs, field indexes, graphs, blobs, channels and sketches.

customer is a map; each user's last event a map with expiry; conversations are sequences; orders a queue; events a
log and channels; orders, lineitem and supplier edges; pages blobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import sketch as S
from polyfold.operators import blob, channel, fieldindex, graph, kv, log, queue, seq
from polyfold.plans.registry import query, table

#: The clock of queries on expiry: 2024-01-29 12:00 UTC.
NOW = 1706529600.0
DAY = 86400.0


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.lit(None).cast("double").alias("expires_at"))


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey = 42")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(_customers(spark, d), 42, NOW).select("key", "value")


@query("SELECT k.key, coalesce(c_name, 'none') AS value FROM (SELECT unnest([1, 7, -5, 99999999])::BIGINT AS key) k LEFT JOIN customer ON c_custkey = k.key")
def kv_fetch_default(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(1,), (7,), (-5,), (99999999,)], "key long")
    return kv.fetch(_customers(spark, d), keys, NOW, "none")


@query("SELECT k.key, c_custkey IS NOT NULL AS present FROM (SELECT unnest([1, -5])::BIGINT AS key) k LEFT JOIN customer ON c_custkey = k.key")
def kv_contains(spark: SparkSession, d: str) -> DataFrame:
    return kv.contains(_customers(spark, d), spark.createDataFrame([(1,), (-5,)], "key long"))


@query("SELECT c_custkey AS key FROM customer")
def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    return kv.keys(_customers(spark, d))


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def kv_items(spark: SparkSession, d: str) -> DataFrame:
    return kv.items(_customers(spark, d))


@query("SELECT count(*) AS n FROM customer")
def kv_count(spark: SparkSession, d: str) -> DataFrame:
    return kv.count(_customers(spark, d))


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 1")
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    return kv.delete(c, c.where("key % 2 = 0")).select("key", "value")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey <= 10 THEN 'new' ELSE c_name END AS value FROM customer UNION ALL SELECT -1, 'new'")
def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    new = c.where("key <= 10").select("key").union(spark.createDataFrame([(-1,)], "key long")).withColumn("value", F.lit("new"))
    return kv.upsert(c, kv.set_rows(new, NOW)).select("key", "value")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, as the snapshot of an operation log, with a day to live."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit("put").alias("op"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("value"), (log.epoch(F.col("ts")) + DAY).alias("expires_at"))
    return kv.latest(e).select("key", "value", "expires_at")


_SESSIONS = "(SELECT user_id AS key, event_type AS value, epoch_us(ts) / 1e6 + 86400.0 AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"


@query(f"SELECT key, value FROM {_SESSIONS} WHERE {NOW} <= expires_at")
def kv_ttl_live(spark: SparkSession, d: str) -> DataFrame:
    return kv.live(_sessions(spark, d), NOW).select("key", "value")


@query(f"SELECT count(*) AS n FROM {_SESSIONS}")
def kv_ttl_raw_count(spark: SparkSession, d: str) -> DataFrame:
    return kv.count(_sessions(spark, d))


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def kv_encrypted(spark: SparkSession, d: str) -> DataFrame:
    key = kv.derive_key("secret", b"0123456789abcdef")
    c = _customers(spark, d).select("key", kv.encrypt(F.col("value"), key).alias("value"))
    return c.select("key", kv.decrypt(F.col("value"), key).alias("value"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("item_order"), F.col("text").alias("item_value"))


_TURNS = "(SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"SELECT conv_id, text AS item_value FROM {_TURNS} WHERE i = 1")
def list_index(spark: SparkSession, d: str) -> DataFrame:
    return seq.at(_turns(spark, d), 1, ["conv_id"]).select("conv_id", "item_value")


@query(f"SELECT conv_id, text AS item_value FROM {_TURNS} WHERE i = n - 2")
def list_neg_index(spark: SparkSession, d: str) -> DataFrame:
    return seq.at(_turns(spark, d), -2, ["conv_id"]).select("conv_id", "item_value")


@query(f"SELECT conv_id, turn AS item_order, text AS item_value FROM {_TURNS} WHERE i >= 1 AND i < n - 1")
def list_slice(spark: SparkSession, d: str) -> DataFrame:
    return seq.slice_(_turns(spark, d), 1, -1, by=["conv_id"])


@query(f"SELECT conv_id, text AS item_value FROM {_TURNS} WHERE i = n - 1")
def list_pop(spark: SparkSession, d: str) -> DataFrame:
    return seq.last(_turns(spark, d), ["conv_id"]).select("conv_id", "item_value")


@query(f"SELECT conv_id, text AS item_value FROM {_TURNS} WHERE i = 0")
def list_deque(spark: SparkSession, d: str) -> DataFrame:
    return seq.first(_turns(spark, d), ["conv_id"]).select("conv_id", "item_value")


@query("SELECT conv_id, turn AS item_order, text AS item_value FROM conversations")
def list_iter(spark: SparkSession, d: str) -> DataFrame:
    return seq.ordered(_turns(spark, d), ["conv_id"])


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def list_count(spark: SparkSession, d: str) -> DataFrame:
    return seq.count(_turns(spark, d), ["conv_id"])


@query(f"SELECT conv_id, turn AS item_order, CASE WHEN i = 0 THEN 'changed' ELSE text END AS item_value FROM {_TURNS}")
def list_set(spark: SparkSession, d: str) -> DataFrame:
    return seq.set_at(_turns(spark, d), 0, "changed", ["conv_id"]).select("conv_id", "item_order", "item_value")


@query(f"SELECT conv_id, turn AS item_order, text AS item_value FROM {_TURNS} WHERE i <> n - 1")
def list_delete(spark: SparkSession, d: str) -> DataFrame:
    return seq.delete_at(_turns(spark, d), -1, ["conv_id"]).select("conv_id", "item_order", "item_value")


@query("SELECT count(*) > 0 AS present FROM conversations WHERE text = 'no such turn'")
def list_contains(spark: SparkSession, d: str) -> DataFrame:
    return seq.contains(_turns(spark, d), "no such turn")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), log.epoch(F.col("o_orderdate")).alias("timestamp"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("data"))


_TASKS = "(SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, epoch_us(o_orderdate) / 1e6 AS timestamp, o_orderkey AS seq, o_totalprice AS data FROM orders)"


@query(f"SELECT * FROM {_TASKS} ORDER BY priority, timestamp, seq LIMIT 1")
def queue_peek(spark: SparkSession, d: str) -> DataFrame:
    return queue.peek(_tasks(spark, d))


@query(f"SELECT * FROM {_TASKS} ORDER BY priority, timestamp, seq LIMIT 100")
def queue_drain_n(spark: SparkSession, d: str) -> DataFrame:
    return queue.drain(_tasks(spark, d), 100)[0]


@query(f"SELECT * FROM {_TASKS} ORDER BY priority, timestamp, seq OFFSET 100")
def queue_after_drain(spark: SparkSession, d: str) -> DataFrame:
    return queue.drain(_tasks(spark, d), 100)[1].select("priority", "timestamp", "seq", "data")


@query(f"SELECT * FROM {_TASKS}")
def queue_iter(spark: SparkSession, d: str) -> DataFrame:
    return queue.ordered(_tasks(spark, d))


@query(f"SELECT count(*) AS n FROM {_TASKS}")
def queue_count(spark: SparkSession, d: str) -> DataFrame:
    return queue.count(_tasks(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(log.epoch(F.col("ts")).alias("timestamp"), F.col("props").alias("data"), "event_id", "event_type", "user_id", "ts")


_LOG = "(SELECT epoch_us(ts) / 1e6 AS timestamp, props AS data, event_id, event_type, user_id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)"
FROM, TO = 1704500000.0, 1705500000.0


@query(f"SELECT timestamp, data, event_id FROM {_LOG} WHERE timestamp >= {FROM} AND timestamp <= {TO}")
def log_range(spark: SparkSession, d: str) -> DataFrame:
    return log.range_(_log(spark, d), FROM, TO, clock="ts").select("timestamp", "data", "event_id")


@query(f"SELECT timestamp, data, event_id FROM {_LOG} WHERE timestamp >= {FROM} ORDER BY timestamp DESC LIMIT 50 OFFSET 100")
def log_range_desc_page(spark: SparkSession, d: str) -> DataFrame:
    return log.range_(_log(spark, d), FROM, order="DESC", limit=50, offset=100, clock="ts").select("timestamp", "data", "event_id")


@query(f"SELECT timestamp, data, event_id FROM {_LOG} WHERE timestamp >= {FROM} AND timestamp <= {TO} AND k >= 40 AND k <> 55")
def log_range_where(spark: SparkSession, d: str) -> DataFrame:
    return log.range_(_log(spark, d), FROM, TO, [P.q("k") >= 40, P.q("k") != 55], clock="ts").select("timestamp", "data", "event_id")


@query(f"SELECT timestamp, data, event_id FROM {_LOG} WHERE timestamp >= {FROM} AND timestamp <= {TO} AND k >= 40 AND k <> 55")
def log_where_indexed(spark: SparkSession, d: str) -> DataFrame:
    m = fieldindex.Manifest().declare("k", complete=True)
    return log.range_(fieldindex.materialise(_log(spark, d), ["k"]), FROM, TO, [P.q("k") >= 40, P.q("k") != 55], manifest=m, clock="ts").select("timestamp", "data", "event_id")


@query("SELECT count(*) AS n FROM events")
def log_count(spark: SparkSession, d: str) -> DataFrame:
    return log.count(_log(spark, d))


@query("SELECT event_type, epoch_us(ts) // 60000000 * 60.0 AS minute, epoch_us(ts) // 60000000 * 60.0 + 1e-6 * (row_number() OVER (PARTITION BY epoch_us(ts) // 60000000 ORDER BY event_id) - 1) AS timestamp FROM events")
def log_separated(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("minute", F.floor(F.col("timestamp") / 60) * 60.0)
    return log.separated(e.withColumn("timestamp", F.col("minute")), tie="event_id").select("event_type", "minute", "timestamp")


@query(f"SELECT floor(timestamp / 3600) * 3600.0 AS window_start, floor(timestamp / 3600) * 3600.0 + 3600.0 AS window_end, count(*) AS n, max(k) AS most FROM {_LOG} GROUP BY 1, 2")
def log_windowed(spark: SparkSession, d: str) -> DataFrame:
    return log.tumbling(_log(spark, d).withColumn("k", F.get_json_object("data", "$.k").cast("double")), 3600, [F.count("*").alias("n"), F.max("k").alias("most")])


_FIELDS = "(SELECT event_id AS item_key, 'event_type' AS field, event_type AS value, CAST(NULL AS DOUBLE) AS value_num FROM events UNION ALL SELECT event_id, 'props.k', props->>'$.k', CAST(props->>'$.k' AS DOUBLE) FROM events)"


def _field_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}")).alias("data"))
    return fieldindex.rows(e, "event_id", "data", ["event_type", "props.k", "props.missing"])


@query(f"SELECT * FROM {_FIELDS}")
def field_index_rows(spark: SparkSession, d: str) -> DataFrame:
    return _field_index(spark, d)


@query(f"SELECT f.field, f.field <> 'props.missing' AS complete, count(x.field) AS n FROM (SELECT unnest(['event_type', 'props.k', 'props.missing']) AS field) f LEFT JOIN {_FIELDS} x USING (field) GROUP BY f.field")
def field_index_stats(spark: SparkSession, d: str) -> DataFrame:
    m = fieldindex.Manifest().declare("event_type", "props.k", complete=True).declare("props.missing")
    return fieldindex.stats(_field_index(spark, d), m)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND CAST(props->>'$.k' AS DOUBLE) > 90")
def field_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return fieldindex.semi_join(table(spark, d, "events").select("event_id", "user_id"), "event_id", _field_index(spark, d), [P.q("event_type") == "click", P.q("props.k") > 90])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.lit(None).cast("string").alias("metadata")
    placed = table(spark, d, "orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"), F.lit("placed").alias("label"), none)
    contains = table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target"), F.lit("contains").alias("label"), none).distinct()
    located = table(spark, d, "supplier").select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"), F.lit("located_in").alias("label"), F.concat(F.lit('{"name":"'), F.col("s_name"), F.lit('"}')).alias("metadata"))
    return placed.union(contains).union(located)


_EDGES = """(SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, 'placed' AS label, CAST(NULL AS VARCHAR) AS metadata FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'contains', CAST(NULL AS VARCHAR) FROM lineitem
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', '{"name":"' || s_name || '"}' FROM supplier)"""


@query(f"SELECT target AS node FROM {_EDGES} WHERE source = 'c7' AND label = 'placed'")
def graph_children(spark: SparkSession, d: str) -> DataFrame:
    return graph.children(_edges(spark, d), "c7", "placed")


@query(f"SELECT source AS node FROM {_EDGES} WHERE target = 'n3'")
def graph_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents(_edges(spark, d), "n3")


@query(f"SELECT * FROM {_EDGES} WHERE source = 's5'")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_edges(spark, d), "s5")


@query(f"SELECT q.source, q.target, q.label, e.source IS NOT NULL AS present FROM (SELECT 's5' AS source, 'n' || s_nationkey AS target, 'located_in' AS label FROM supplier WHERE s_suppkey = 5 UNION ALL SELECT 's5', 'nowhere', 'located_in') q LEFT JOIN {_EDGES} e USING (source, target, label)")
def graph_linked(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    pairs = graph.edges(e, "s5").select("source", "target", "label").union(spark.createDataFrame([("s5", "nowhere", "located_in")], "source string, target string, label string"))
    return graph.linked(e, pairs)


@query(f"SELECT count(*) AS n FROM {_EDGES}")
def graph_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.count(_edges(spark, d))


@query(f"SELECT source, target, label, CASE WHEN source = 's5' THEN '{{\"moved\":true}}' ELSE metadata END AS metadata FROM {_EDGES} WHERE label = 'located_in' UNION ALL SELECT 's5', 'n0', 'visits', NULL")
def graph_link(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where("label = 'located_in'")
    moved = graph.edges(e, "s5").withColumn("metadata", F.lit('{"moved":true}'))
    return graph.link(e, moved.union(spark.createDataFrame([("s5", "n0", "visits", "{}")], "source string, target string, label string, metadata string")))


@query(f"WITH e AS (SELECT * FROM {_EDGES}), a AS (SELECT DISTINCT target AS node FROM e WHERE source = 'c7'), b AS (SELECT DISTINCT target AS node FROM e JOIN a ON source = a.node) SELECT 'c7' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b WHERE node NOT IN (SELECT node FROM a)")
def graph_bfs2(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 2)


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").cast("binary").alias("data"), F.col("url").alias("metadata"))


@query("SELECT page_id AS key, CAST(octet_length(encode(html)) AS BIGINT) AS size, url AS metadata FROM pages")
def blob_items_size(spark: SparkSession, d: str) -> DataFrame:
    return blob.items(_blobs(spark, d)).withColumn("size", F.col("size").cast("long"))


@query("SELECT page_id AS key, html AS text FROM pages WHERE page_id = 3")
def blob_fetch(spark: SparkSession, d: str) -> DataFrame:
    return blob.fetch(_blobs(spark, d), 3).select("key", F.col("data").cast("string").alias("text"))


@query("SELECT count(*) > 0 AS present FROM pages WHERE page_id = 3")
def blob_contains(spark: SparkSession, d: str) -> DataFrame:
    return blob.contains(_blobs(spark, d), 3)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(log.epoch(F.col("ts")).alias("timestamp"), F.col("event_type").alias("channel"), F.col("props").alias("payload"), "event_id")


@query("SELECT epoch_us(ts) / 1e6 AS timestamp, event_type AS channel, props AS payload, event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 100")
def channel_history(spark: SparkSession, d: str) -> DataFrame:
    return channel.history(_messages(spark, d), "click", 100)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def channel_count(spark: SparkSession, d: str) -> DataFrame:
    return channel.count(_messages(spark, d), "click")


# Sketches of the distinct parts of lineitem; p is 14 at an error of 0.01.
_LE = lambda h, a: " || ".join(f"substr({h}, {a + 2 * i}, 2)" for i in range(7, -1, -1))
_REG = f"""(SELECT register, max(rank) AS rank FROM (SELECT CAST(h & 16383 AS INTEGER) AS register,
 CAST(least(CASE WHEN h >> 14 = 0 THEN 64 ELSE bit_count(((h >> 14) & -(h >> 14)) - 1) END, 50) + 1 AS INTEGER) AS rank
 FROM (SELECT CAST(('0x' || {_LE("s", 1)})::UBIGINT AS HUGEINT) AS h FROM (SELECT DISTINCT sha1(CAST(l_partkey AS VARCHAR)) AS s FROM lineitem))) GROUP BY register)"""


def _registers(spark: SparkSession, d: str) -> DataFrame:
    return S.hll_registers(table(spark, d, "lineitem"), S.item_text(F.col("l_partkey"), "bigint"), 0.01)


@query(_REG[1:-1])
def sketch_hll_registers(spark: SparkSession, d: str) -> DataFrame:
    return _registers(spark, d)


@query(f"SELECT CAST(trunc(CASE WHEN raw <= 40960 AND zeros > 0 THEN 16384.0::DOUBLE * ln(16384.0::DOUBLE / zeros) ELSE raw END) AS BIGINT) AS n FROM (SELECT 16384 - count(*) AS zeros, (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 16384)) * 16384 * 16384 / (sum(pow(2.0::DOUBLE, -rank)) + 16384 - count(*)) AS raw FROM {_REG})")
def sketch_hll_count(spark: SparkSession, d: str) -> DataFrame:
    return S.hll_count(_registers(spark, d), 0.01)


def _bits(table_sql: str, key: str, bits: int, hashes: int) -> str:
    return f"SELECT DISTINCT {key} AS k, (a + i * b) % {bits} AS pos FROM (SELECT {key}, ('0x' || {_LE('h', 1)})::UBIGINT::HUGEINT % {bits} AS a, ('0x' || {_LE('h', 17)})::UBIGINT::HUGEINT % {bits} AS b FROM (SELECT DISTINCT {key}, md5(CAST({key} AS VARCHAR)) AS h FROM {table_sql})) x, (SELECT unnest(range({hashes})) AS i) y"


CAPACITY = 1000
_M, _K = S.bloom_size(CAPACITY, 0.01)


@query(f"WITH s AS (SELECT DISTINCT pos FROM ({_bits('lineitem', 'l_suppkey', _M, _K)})), w AS ({_bits('part', 'p_partkey', _M, _K)}) SELECT w.k AS p_partkey, count(*) = count(s.pos) AS maybe FROM w LEFT JOIN s USING (pos) GROUP BY w.k")
def sketch_bloom_contains(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose key may be that of a supplier."""
    bits = S.bloom_bits(table(spark, d, "lineitem"), S.item_text(F.col("l_suppkey"), "bigint"), CAPACITY, 0.01)
    return S.bloom_contains(table(spark, d, "part"), "p_partkey", S.item_text(F.col("p_partkey"), "bigint"), bits, CAPACITY, 0.01)
