"""The registered queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import APPLY_SCHEMA, has_bit
from tidemark.functions import types as T
from tidemark.functions.text import escape_text
from tidemark.operators import apply as A
from tidemark.operators import changes as C
from tidemark.operators import consolidate as U
from tidemark.operators import errors as M
from tidemark.operators import ledger as B
from tidemark.operators import manifest as N
from tidemark.operators import retention as R
from tidemark.operators import schema as S
from tidemark.operators import shards as H
from tidemark.plans import fixtures as X
from tidemark.sources import delimited, store
from tidemark.sources.paths import scratch, table
from tidemark.spec import OP, VERSION, TableSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def orders_sql(start: int = 0, stop: int = 10**12) -> str:
    return "WITH " + X.ORDERS_SQL.format(start=start, stop=stop)


EVENTS = "WITH " + X.EVENTS_SQL
LEDGER = "WITH " + X.LEDGER_SQL


def changes_of_orders(spark: SparkSession, d: str, start: int = 0, stop: int = 10**12) -> DataFrame:
    return C.capture_changes(X.orders_log(spark, d), X.orders_now(spark, d), X.ORDERS, start, stop)


# capture -------------------------------------------------------------------------------------------

NET = """SELECT {keys}, max(version) AS _version,
  CASE WHEN arg_max(op, version) = 'D' THEN 'D' WHEN max(CASE WHEN op = 'I' THEN version END) IS NOT NULL THEN 'I' ELSE 'U' END AS _op,
  max(CASE WHEN op = 'I' THEN version END) AS creation_version FROM {log} GROUP BY {keys}"""


@query(EVENTS + NET.format(keys="k", log="events_log"))
def net_changes(spark, d):
    return C.net_changes(X.events_log(spark, d), ("k",))


@query(orders_sql(1100, 10_000_000) + "SELECT * FROM changes")
def capture_changes(spark, d):
    return changes_of_orders(spark, d, 1100, 10_000_000)


@query(
    EVENTS
    + """, w AS (SELECT k, max(version) AS _version, arg_max(op, version) AS _op FROM events_log WHERE ts > TIMESTAMP '2024-01-08' GROUP BY k)
SELECT w.k, CASE WHEN _op <> 'D' THEN c_name END AS c_name, CASE WHEN _op <> 'D' THEN c_nationkey END AS c_nationkey, _version, _op
FROM w LEFT JOIN customer ON c_custkey = k WHERE _op = 'D' OR c_custkey IS NOT NULL"""
)
def capture_by_time(spark, d):
    base = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    log = X.events_log(spark, d).select("k", "version", "op", "ts")
    return C.capture_by_time(log, base, TableSpec("customer", ("k",), ("c_name", "c_nationkey")), F.lit("2024-01-08").cast("timestamp"))


@query(
    """WITH r AS (SELECT user_id AS feed, count(*) AS ctid, arg_max(event_type, event_id) <> 'error' AS finished FROM events GROUP BY 1)
SELECT feed, CASE WHEN finished THEN ctid + 1 ELSE ctid END AS ctid, TIMESTAMP '2024-06-01 11:59:59' AS ts, false AS finished FROM r
UNION ALL SELECT user_id, n, ts, event_type <> 'error' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
WHERE n < total OR event_type <> 'error'"""
)
def next_time_window(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id feed", "cast(row_number() over (partition by user_id order by event_id) as bigint) ctid", "ts", "event_type <> 'error' finished")
    return C.next_time_window(rows, F.lit("2024-06-01 12:00:00").cast("timestamp"))


@query(EVENTS + "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM events_log) WHERE n = 1")
def dedupe_changes(spark, d):
    return C.dedupe_changes(X.events_log(spark, d), ("k",), ("version",))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def project_columns(spark, d):
    return C.project_columns(table(spark, d, "orders"), TableSpec("orders", ("o_orderkey",), ("O_TOTALPRICE",)), ("o_orderdate",))


@query("SELECT doc_id, left(text, 20) AS text, lang, source, left(CAST(n_chars AS VARCHAR), 2) AS n_chars FROM documents")
def shorten(spark, d):
    return C.shorten(table(spark, d, "documents"), {"TEXT": 20, "n_chars": 2})


@query("SELECT event_id AS CT_ID, user_id AS X_MIN, value FROM events")
def rename_reserved(spark, d):
    return C.rename_reserved(table(spark, d, "events").selectExpr("event_id ctid", "user_id xmin", "value"))


@query("SELECT user_id AS schema_id, 'dbo' AS schema_name, event_type AS table_name, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id, event_type")
def subscribed_tables(spark, d):
    manifest = table(spark, d, "events").groupBy(F.col("user_id").alias("schema_id"), F.lit("dbo").alias("schema_name"), F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
    return C.subscribed_tables(manifest, [TableSpec("CLICK"), TableSpec("error")])


@query(EVENTS + "SELECT k, value FROM events_log")
def strip_meta(spark, d):
    return C.strip_meta(X.change_rows(spark, d))


# consolidate and merge -----------------------------------------------------------------------------


def _batches(spark, d):
    return U.batch_numbers(X.events_log(spark, d), 5)


@query(
    EVENTS
    + """SELECT k, CASE WHEN ctid >= 3 THEN value END AS value, version AS _version, op AS _op
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, ctid DESC) AS n FROM batches) WHERE n = 1"""
)
def consolidate(spark, d):
    rows = _batches(spark, d).selectExpr("ctid", "k", "value", "version _version", "op _op")
    sets = []
    for c in range(1, 6):
        one = rows.where(F.col("ctid") == c).drop("ctid")
        sets.append((c, one if c >= 3 else one.drop("value").withColumnRenamed("k", "K")))
    return U.consolidate(sets, ("k",))


MANIFEST = EVENTS + ", m AS (SELECT ctid, 'dbo' AS schema_name, 'T' || (k % 40) AS table_name, count(*) FILTER (op <> 'D') AS expected_rows FROM batches GROUP BY ctid, k % 40)"


def _manifests(spark, d):
    named = _batches(spark, d).selectExpr("ctid", "'dbo' schema_name", "concat('T', k % 40) table_name", "op")
    return named.groupBy("ctid", "schema_name", "table_name").agg(F.count_if(F.col("op") != "D").alias("expected_rows"))


@query(MANIFEST + "SELECT * FROM m WHERE expected_rows > 0")
def tables_with_changes(spark, d):
    return U.tables_with_changes(_manifests(spark, d))


@query(MANIFEST + "SELECT schema_name, table_name, max(ctid) AS ctid, arg_max(expected_rows, ctid) AS expected_rows, count(*) AS batches FROM m WHERE expected_rows > 0 GROUP BY 1, 2")
def latest_change_sets(spark, d):
    return U.latest_change_sets(_manifests(spark, d))


SHARDS = EVENTS + """, s AS (
  SELECT CAST(k % 3 AS VARCHAR) AS shard, k % 40 AS key, arg_max(value, version) AS value, max(version) AS _version, arg_max(op, version) AS _op FROM events_log GROUP BY 1, 2),
o AS (SELECT *, CASE shard WHEN '1' THEN 0 WHEN '0' THEN 1 ELSE 2 END AS ord FROM s)"""


def _shards(spark, d):
    rows = X.events_log(spark, d).selectExpr("cast(k % 3 as string) shard", "k % 40 key", "value", "version", "op")
    return rows.groupBy("shard", "key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias(VERSION), F.max_by("op", "version").alias(OP))


@query(SHARDS + "SELECT shard, key, value, _version, _op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY _op = 'D', ord) AS n FROM o) WHERE n = 1")
def merge_shards(spark, d):
    return H.merge_shard_rows(_shards(spark, d), ("key",), ["1", "0", "2"])


@query(
    SHARDS
    + """, m AS (SELECT shard, ord, 'dbo' AS schema_name, 'T' || key AS table_name, _version FROM o)
SELECT shard, schema_name, table_name, _version FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, lower(table_name) ORDER BY ord) AS n FROM m) WHERE n = 1"""
)
def merge_manifests(spark, d):
    rows = _shards(spark, d).select("shard", F.lit("dbo").alias("schema_name"), F.concat(F.lit("T"), F.col("key").cast("string")).alias("table_name"), VERSION)
    return H.merge_manifests(rows, ["1", "0", "2"])


SHAPES = """WITH c AS (
  SELECT 'T' || (p_partkey // 12) AS table_name, CAST(p_partkey % 3 AS VARCHAR) AS shard, 'c' || (p_partkey // 3 % 4) AS column_name,
         p_partkey // 3 % 4 = 0 AS is_pk, CASE WHEN p_size > 45 THEN 'bigint' ELSE 'int' END AS data_type FROM part),
h AS (SELECT table_name, shard, string_agg(column_name || is_pk || data_type, ',' ORDER BY column_name) AS shape FROM c GROUP BY 1, 2)
"""


@query(SHAPES + "SELECT table_name, count(DISTINCT shape) AS shapes FROM h GROUP BY 1 HAVING count(DISTINCT shape) > 1")
def schemas_out_of_sync(spark, d):
    listing = table(spark, d, "part").selectExpr(
        "concat('T', p_partkey div 12) table_name", "cast(p_partkey % 3 as string) shard", "concat('c', p_partkey div 3 % 4) column_name",
        "p_partkey div 3 % 4 = 0 is_pk", "if(p_size > 45, 'bigint', 'int') data_type",
    )
    return H.schemas_out_of_sync(listing)


@query("SELECT l_partkey AS table_id, l_linenumber AS event_id, l_quantity AS value FROM lineitem WHERE l_returnflag = 'A'")
def shard_schema_changes(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag shard", "l_partkey table_id", "l_linenumber event_id", "l_quantity value")
    return H.shard_schema_changes(rows, "A")


# apply ---------------------------------------------------------------------------------------------


@query(orders_sql() + "SELECT * FROM orders_now")
def apply_merge(spark, d):
    return A.apply_merge(X.orders_before(spark, d), changes_of_orders(spark, d), X.ORDERS)


@query(
    orders_sql()
    + """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders_before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT o_orderkey, o_custkey, NULL, o_totalprice, NULL, NULL FROM changes WHERE _op <> 'D'"""
)
def apply_delete_insert(spark, d):
    changes = changes_of_orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", VERSION, OP)
    return A.apply_delete_insert(X.orders_before(spark, d), changes, X.ORDERS)


@query(
    orders_sql()
    + """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders_before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM changes WHERE _op <> 'D'"""
)
def apply_replace(spark, d):
    changes = changes_of_orders(spark, d)
    older = changes.where(F.col(OP) != "D").withColumns({VERSION: F.col(VERSION) - 1, "o_orderstatus": F.lit("?")})
    return A.apply_replace(X.orders_before(spark, d), changes.unionByName(older), X.ORDERS)


@query(
    """SELECT c_name, CASE WHEN c_custkey % 4 = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 2
UNION ALL SELECT lower(c_name) || '-new', c_nationkey, NULL FROM customer WHERE c_custkey % 4 = 3"""
)
def apply_ignore_case(spark, d):
    customer = table(spark, d, "customer")
    rows = customer.selectExpr(
        "if(c_custkey % 4 = 3, concat(lower(c_name), '-new'), lower(c_name)) c_name", "if(c_custkey % 4 = 1, c_nationkey + 100, c_nationkey) c_nationkey",
        "c_custkey _version", "element_at(array('U', 'D', 'I'), cast(c_custkey % 4 as int)) _op", "c_custkey % 4 <> 0 sent",
    ).where("sent").drop("sent")
    return A.apply_merge(customer.select("c_name", "c_nationkey", "c_acctbal"), rows, TableSpec("customer", ("c_name",), ignore_case=True))


@query(
    orders_sql()
    + """SELECT count(*) FILTER (_op <> 'D') AS inserted, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM orders_before)) AS deleted FROM changes"""
)
def apply_counts(spark, d):
    return A.apply_counts(X.orders_before(spark, d), changes_of_orders(spark, d), X.ORDERS)


@query(
    """WITH t AS (SELECT DISTINCT 'T' || (p_partkey // 3) || CASE WHEN p_partkey % 3 = 1 THEN 'Archive' ELSE '' END AS n FROM part WHERE p_size % 2 = 0),
s AS (SELECT n, replace(n, 'Archive', '') AS stem FROM t)
SELECT coalesce(max(CASE WHEN n = stem THEN n END), max(n)) AS table_name, CASE WHEN max(CASE WHEN n = stem THEN n END) IS NOT NULL THEN max(CASE WHEN n <> stem THEN n END) END AS archive_name
FROM s GROUP BY stem"""
)
def pair_archives(spark, d):
    names = table(spark, d, "part").where("p_size % 2 = 0").selectExpr("concat('T', p_partkey div 3, if(p_partkey % 3 = 1, 'Archive', '')) table_name")
    return A.pair_archives(names)


@query(orders_sql() + "SELECT * FROM orders_now")
def apply_to_buckets(spark, d):
    """The merge again, through the store: only touched buckets are read and replaced."""
    root = scratch(spark, "target")
    store.initial_load(X.orders_before(spark, d), X.ORDERS, root)
    store.write_change_set(changes_of_orders(spark, d), root, "orders", 1)
    store.apply_to_buckets(spark, store.read_change_set(spark, root, "orders", 1), X.ORDERS, root)
    return store.read_target(spark, root, X.ORDERS)


@query(orders_sql() + "SELECT 'live' AS part, * FROM orders_now WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT 'archive', * FROM orders_now WHERE o_orderdate < TIMESTAMP '1997-01-01'")
def apply_group(spark, d):
    """A table and its archive changed together by one pointer write."""
    root, cut = scratch(spark, "group"), "o_orderdate < timestamp '1997-01-01'"
    before, log, now = X.orders_before(spark, d), X.orders_log(spark, d), X.orders_now(spark, d)
    group, parts = [], []
    old = before.where(cut).select("o_orderkey").union(now.where(cut).select("o_orderkey")).distinct()
    for name, archive in (("Orders", False), ("OrdersArchive", True)):
        spec, how = TableSpec(name, ("o_orderkey",)), cut if archive else f"not ({cut})"
        store.initial_load(before.where(how), spec, root)
        changes = C.capture_changes(log.join(old, "o_orderkey", "left_semi" if archive else "left_anti"), now.where(how), spec, 0, 10**12)
        group.append((spec, changes))
    store.apply_group(spark, root, group)
    for (spec, _), label in zip(group, ("live", "archive"), strict=True):
        parts.append(store.read_target(spark, root, spec).withColumn("part", F.lit(label)))
    return parts[0].unionByName(parts[1])


# manifests -----------------------------------------------------------------------------------------

TABLES = "tables AS (SELECT DISTINCT 'T' || (c_custkey % 60) AS table_name FROM customer), ch AS (SELECT 'T' || (k % 40) AS table_name, op AS _op FROM events_log)"


def _tables(spark, d):
    return table(spark, d, "customer").selectExpr("concat('T', c_custkey % 60) table_name").distinct()


def _named_changes(spark, d):
    return X.events_log(spark, d).selectExpr("concat('T', k % 40) table_name", "op _op")


@query(
    EVENTS + "," + TABLES
    + """ SELECT 'dbo' AS schema_name, t.table_name, 'k' AS pk, count(c._op) AS expected_rows, count(*) FILTER (c._op IN ('I', 'U')) AS insert_count
FROM tables t LEFT JOIN ch c ON t.table_name = c.table_name GROUP BY t.table_name"""
)
def build_manifest(spark, d):
    tables = _tables(spark, d).select("table_name", F.lit("dbo").alias("schema_name"), F.array(F.lit("k")).alias("pk"))
    return N.render_keys(N.build_manifest(_named_changes(spark, d), tables))


@query(EVENTS + "," + TABLES + " SELECT t.table_name, count(c._op) AS rows FROM tables t LEFT JOIN ch c ON t.table_name = c.table_name GROUP BY t.table_name")
def row_counts(spark, d):
    return N.row_counts(_named_changes(spark, d), _tables(spark, d))


@query(EVENTS + "," + TABLES + " SELECT count(*) AS rows FROM ch WHERE table_name IN (SELECT table_name FROM tables)")
def total_captured(spark, d):
    return N.total_captured(N.row_counts(_named_changes(spark, d), _tables(spark, d)))


@query(
    MANIFEST
    + """, e AS (SELECT table_name, sum(expected_rows) AS expected FROM m GROUP BY 1),
a AS (SELECT 'T' || (k % 50) AS table_name, count(*) FILTER (op = 'U') AS inserted FROM events_log GROUP BY 1),
j AS (SELECT coalesce(e.table_name, a.table_name) AS table_name, coalesce(expected, 0) AS expected, coalesce(inserted, 0) AS inserted FROM e FULL JOIN a ON e.table_name = a.table_name)
SELECT 'dbo' AS schema_name, table_name, CAST(expected AS BIGINT) AS expected, inserted, CASE WHEN expected > 0 THEN CAST(trunc((expected - inserted) * 100 / expected) AS BIGINT) WHEN inserted = 0 THEN 0 END AS percent,
       expected = 0 AND inserted > 0 AS error FROM j"""
)
def audit_counts(spark, d):
    applied = X.events_log(spark, d).groupBy(F.expr("concat('T', k % 50)").alias("table_name")).agg(F.count_if(F.col("op") == "U").alias("inserted"))
    return N.audit_counts(_manifests(spark, d).withColumnRenamed("expected_rows", "insert_count"), applied)


@query(
    """SELECT 'T' || p_partkey AS table_name, p_brand || '+' || p_type AS pk, CASE WHEN p_size > 40 THEN 'no primary key in the manifest' END AS error
FROM part WHERE p_size <= 40 UNION ALL SELECT 'T' || p_partkey, NULL, 'no primary key in the manifest' FROM part WHERE p_size > 40"""
)
def resolve_pks(spark, d):
    part = table(spark, d, "part")
    manifest = part.where("p_size <= 40").selectExpr("concat('t', p_partkey) table_name", "concat(p_brand, ', ', p_type) pk")
    return N.resolve_pks(manifest, part.selectExpr("concat('T', p_partkey) table_name")).withColumn("pk", F.array_join("pk", "+"))


# ledgers -------------------------------------------------------------------------------------------


@query(LEDGER + "SELECT feed, coalesce(max(CASE WHEN ctid < 15 AND sync_bitwise & 4 > 0 THEN sync_start_time END), TIMESTAMP '2023-12-31') AS last_start_time FROM ledger GROUP BY feed")
def last_start_time(spark, d):
    return B.last_start_time(X.ledger(spark, d), F.lit(15), 4, F.lit("2023-12-31").cast("timestamp"))


LAST = "last AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ctid DESC) AS n FROM ledger) WHERE n = 1)"


@query(LEDGER + "," + LAST + " SELECT * FROM last")
def last_batch(spark, d):
    return B.last_batch(X.ledger(spark, d))


PENDING = """, seen AS (SELECT feed, subscriber, max(ctid) AS upto FROM subscribers GROUP BY 1, 2)
SELECT l.feed, l.ctid, l.sync_start_version, l.sync_stop_version, l.sync_start_time, l.sync_stop_time, l.sync_bitwise, s.subscriber
FROM ledger l JOIN seen s ON l.feed = s.feed WHERE l.ctid > s.upto AND l.sync_bitwise & 4 > 0"""


@query(LEDGER + PENDING)
def pending_batches(spark, d):
    last = X.subscribers(spark, d).groupBy("feed", "subscriber").agg(F.max("ctid").alias("ctid"))
    return B.pending_batches(X.ledger(spark, d), last)


INCOMPLETE = "done AS (SELECT feed, subscriber, max(ctid) AS upto FROM subscribers WHERE sync_bitwise = 255 GROUP BY 1, 2), open AS (SELECT s.* FROM subscribers s JOIN done d ON s.feed = d.feed AND s.subscriber = d.subscriber WHERE ctid > upto)"


@query(LEDGER + "," + INCOMPLETE + " SELECT * FROM open")
def incomplete_batches(spark, d):
    return B.incomplete_batches(X.subscribers(spark, d))


@query(
    LEDGER + "," + LAST
    + """, v AS (SELECT c_custkey AS feed, CAST(1000000 + c_custkey AS BIGINT) AS cur FROM customer)
SELECT v.feed, CASE WHEN sync_bitwise & 4 > 0 THEN ctid + 1 ELSE ctid END AS ctid, CASE WHEN sync_bitwise & 4 > 0 THEN sync_stop_version ELSE sync_start_version END AS sync_start_version,
       CASE WHEN ctid IS NULL THEN NULL WHEN sync_bitwise & 4 > 0 THEN cur WHEN sync_bitwise & 2 > 0 THEN sync_stop_version ELSE cur END AS sync_stop_version,
       CASE WHEN sync_bitwise & 4 > 0 THEN 0 ELSE sync_bitwise END AS sync_bitwise,
       CASE WHEN ctid IS NULL THEN NULL WHEN sync_bitwise & 4 > 0 THEN 'new' WHEN sync_bitwise & 2 > 0 THEN 'resume' ELSE 'retry' END AS plan,
       CASE WHEN ctid IS NULL THEN 'the ledger has no batch of this feed' END AS error
FROM v LEFT JOIN last l ON v.feed = l.feed"""
)
def plan_batch(spark, d):
    versions = table(spark, d, "customer").selectExpr("c_custkey feed", "1000000 + c_custkey current_version")
    return B.plan_batch(X.ledger(spark, d), versions)


@query(
    LEDGER
    + """SELECT * EXCLUDE (sync_stop_version), CASE WHEN sync_stop_version - sync_start_version <= 50 THEN sync_stop_version WHEN hour(t) >= 22 OR strftime(t, '%H:%M:%S') <= '02:00:00' THEN sync_stop_version + 7
  WHEN sync_stop_version - sync_start_version > 50 THEN sync_start_version + 50 ELSE sync_stop_version END AS sync_stop_version
FROM (SELECT *, sync_start_time + to_minutes(CAST(sync_start_version % 1440 AS INTEGER)) + INTERVAL 30 SECOND AS t FROM ledger)"""
)
def resize_batches(spark, d):
    rows = X.ledger(spark, d).withColumns({"current": F.expr("sync_stop_version + 7"), "t": F.expr("sync_start_time + make_dt_interval(0, 0, cast(sync_start_version % 1440 as int), 30)")})
    return B.resize_batches(rows, 50, F.col("t"), "22:00:00", "02:00:00", "current").drop("current")


STARTS = """, b AS (SELECT feed, ctid, CASE WHEN feed % 3 = 0 THEN 0 ELSE sync_start_version END AS start FROM last),
t AS (SELECT DISTINCT user_id AS feed, event_type AS table_name, 10 + user_id AS min_valid_version FROM events),
r AS (SELECT user_id AS feed, 'click' AS table_name, CAST(5000 + user_id AS BIGINT) AS next_version, user_id % 5 = 0 AS in_progress FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT t.feed, b.ctid, t.table_name, t.min_valid_version, coalesce(next_version, CASE WHEN start = 0 THEN min_valid_version ELSE start END) AS start_version
FROM t JOIN b ON t.feed = b.feed LEFT JOIN r ON t.feed = r.feed AND t.table_name = r.table_name WHERE NOT coalesce(in_progress, false)"""


def _starts(spark, d):
    batches = B.last_batch(X.ledger(spark, d)).withColumn("sync_start_version", F.expr("if(feed % 3 = 0, 0, sync_start_version)"))
    tables = table(spark, d, "events").selectExpr("user_id feed", "event_type table_name", "10 + user_id min_valid_version").distinct()
    registry = tables.where("table_name = 'click' and feed % 2 = 0").selectExpr("feed", "table_name", "5000 + feed next_version", "feed % 5 = 0 in_progress")
    have = table(spark, d, "events").where("user_id % 2 = 0").selectExpr("user_id feed", "'click' table_name", "5000 + user_id next_version", "user_id % 5 = 0 in_progress").distinct()
    return B.table_start_versions(batches, tables, registry.unionByName(have).distinct())


@query(LEDGER + "," + LAST + STARTS)
def table_start_versions(spark, d):
    return _starts(spark, d)


@query(
    """WITH t AS (SELECT event_id AS feed, event_type AS table_name, user_id AS start_version FROM events),
c AS (SELECT event_id AS feed, event_type AS table_name, value > 5 AS tracked, user_id + CAST(event_id % 2 AS BIGINT) AS min_valid_version FROM events WHERE event_id % 7 <> 0)
SELECT t.*, CASE WHEN c.feed IS NULL THEN 'table does not exist' WHEN NOT tracked THEN 'changes are not tracked' WHEN start_version < min_valid_version THEN 'start version is no longer valid' END AS reason
FROM t LEFT JOIN c ON t.feed = c.feed AND t.table_name = c.table_name"""
)
def validate_sources(spark, d):
    e = table(spark, d, "events")
    catalog = e.where("event_id % 7 <> 0").selectExpr("event_id feed", "event_type table_name", "value > 5 tracked", "user_id + event_id % 2 min_valid_version")
    return B.validate_sources(e.selectExpr("event_id feed", "event_type table_name", "user_id start_version"), catalog)


@query(LEDGER + "SELECT * EXCLUDE (sync_bitwise), CASE WHEN ctid > 3 THEN sync_bitwise | 8 ELSE sync_bitwise END AS sync_bitwise FROM ledger")
def set_bit(spark, d):
    once = B.set_bit(X.ledger(spark, d), F.col("ctid") > 3, APPLY_SCHEMA)
    return B.set_bit(once, has_bit(F.col("sync_bitwise"), APPLY_SCHEMA), APPLY_SCHEMA)


@query(LEDGER + "SELECT * EXCLUDE (sync_bitwise, sync_stop_time), CASE WHEN ctid > 20 THEN 255 ELSE sync_bitwise END AS sync_bitwise, CASE WHEN ctid > 20 THEN TIMESTAMP '2024-06-01' ELSE sync_stop_time END AS sync_stop_time FROM subscribers")
def mark_complete(spark, d):
    return B.mark_complete(X.subscribers(spark, d), F.col("ctid") > 20, F.lit("2024-06-01").cast("timestamp"))


@query(
    LEDGER + "," + INCOMPLETE
    + """, idle AS (SELECT feed, subscriber, max(ctid) AS upto FROM subscribers s WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.feed = s.feed AND o.subscriber = s.subscriber) GROUP BY 1, 2),
todo AS (SELECT feed, subscriber, ctid, sync_start_version, sync_stop_version, sync_bitwise, 'resume' AS why FROM open
  UNION ALL SELECT l.feed, subscriber, ctid, sync_start_version, sync_stop_version, 0, 'new' FROM ledger l JOIN idle i ON l.feed = i.feed WHERE ctid > upto AND sync_bitwise & 4 > 0)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY feed, subscriber) < 3 THEN 'single' ELSE 'merged' END AS mode FROM todo"""
)
def plan_subscriber(spark, d):
    return B.plan_subscriber(X.ledger(spark, d), X.subscribers(spark, d), 3)


@query(
    """WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
h AS (SELECT event_id, ts, prev, strftime(ts, '%H:%M:%S') AS t, strftime(prev, '%H:%M:%S') AS b FROM p WHERE prev IS NOT NULL AND prev <= ts)
SELECT event_id, ('06:00:00' < t AND (CAST(prev AS DATE) < CAST(ts AS DATE) OR b < '06:00:00')) OR ('18:30:00' < t AND (CAST(prev AS DATE) < CAST(ts AS DATE) OR b < '18:30:00')) AS due FROM h"""
)
def full_run_time(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "ts", "lag(ts) over (partition by user_id order by event_id) prev").where("prev is not null and prev <= ts")
    hours = F.array(F.lit("06:00:00"), F.lit("18:30:00"))
    return rows.select("event_id", B.is_full_run_time(F.col("prev"), F.col("ts"), hours).alias("due"))


@query(LEDGER + "SELECT ctid, bool_and(sync_bitwise & 4 > 0) AS ready, count(*) AS shards FROM ledger GROUP BY ctid")
def shards_ready(spark, d):
    return H.shards_ready(X.ledger(spark, d))


@query(LEDGER + "SELECT * EXCLUDE (sync_bitwise), CASE WHEN ctid IN (SELECT ctid FROM ledger WHERE sync_bitwise & 4 = 0) THEN 0 ELSE sync_bitwise END AS sync_bitwise FROM ledger")
def revert_shards(spark, d):
    rows = X.ledger(spark, d)
    return H.revert(rows, rows.where(~has_bit(F.col("sync_bitwise"), 4)))


@query(LEDGER + "SELECT feed AS shard, (SELECT max(ctid) + 1 FROM ledger) AS ctid, arg_max(sync_stop_version, ctid) AS sync_start_version FROM ledger GROUP BY feed")
def next_shard_versions(spark, d):
    return H.next_shard_versions(X.ledger(spark, d).withColumnRenamed("feed", "shard"))


REGISTRY = "SELECT user_id AS feed, event_type AS table_name, max(event_id) AS next_version, bool_or(value > 30) AS in_progress, min(ts) AS started, CASE WHEN bool_or(value > 30) THEN NULL ELSE max(ts) END AS finished FROM events GROUP BY 1, 2"


def _registry(spark, d):
    big = F.bool_or(F.col("value") > 30)
    got = table(spark, d, "events").groupBy(F.col("user_id").alias("feed"), F.col("event_type").alias("table_name"))
    return got.agg(F.max("event_id").alias("next_version"), big.alias("in_progress"), F.min("ts").alias("started"), F.when(~big, F.max("ts")).alias("finished"))


@query(
    f"""WITH r AS ({REGISTRY}), n AS (SELECT user_id AS feed, event_type AS table_name, min(event_id) AS next_version, min(ts) AS started FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT * FROM r WHERE table_name <> 'click' UNION ALL SELECT feed, table_name, next_version, true, started, NULL FROM n"""
)
def register_init(spark, d):
    new = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("feed"), F.col("event_type").alias("table_name"))
    return B.register_init(_registry(spark, d), new.agg(F.min("event_id").alias("next_version"), F.min("ts").alias("started")))


@query(LEDGER + f", r AS ({REGISTRY}), " + LAST + " SELECT r.* FROM r LEFT JOIN last l ON r.feed = l.feed WHERE NOT coalesce(NOT in_progress AND finished < sync_start_time, false)")
def cleanup_init(spark, d):
    return B.cleanup_init(_registry(spark, d), B.last_batch(X.ledger(spark, d)))


@query(f"SELECT * EXCLUDE (in_progress, finished), in_progress AND feed % 2 = 1 AS in_progress, CASE WHEN feed % 2 = 0 THEN TIMESTAMP '2024-06-01' ELSE finished END AS finished FROM ({REGISTRY})")
def finish_init(spark, d):
    return B.finish_init(_registry(spark, d), F.col("feed") % 2 == 0, F.lit("2024-06-01").cast("timestamp"))


# retention, errors ---------------------------------------------------------------------------------

CUT = "2024-01-12 00:30:00"


@query(
    LEDGER
    + f"""SELECT 'publisher' AS scope, feed, ctid, NULL AS subscriber FROM ledger WHERE sync_start_time < TIMESTAMP '{CUT}'
UNION ALL SELECT 'subscriber', feed, ctid, subscriber FROM subscribers WHERE sync_stop_time < TIMESTAMP '{CUT}'
UNION ALL SELECT 'relay', feed, ctid, NULL FROM subscribers GROUP BY feed, ctid HAVING max(sync_stop_time) < TIMESTAMP '{CUT}'"""
)
def expired_ctids(spark, d):
    cut = F.lit(CUT).cast("timestamp")
    parts = [R.expired_ctids(X.ledger(spark, d) if s == "publisher" else X.subscribers(spark, d), cut, s).withColumn("scope", F.lit(s)) for s in ("publisher", "subscriber", "relay")]
    return A.union_all([parts[1], parts[0], parts[2]])


@query(LEDGER + f"SELECT feed, sync_stop_version AS ctid FROM ledger WHERE sync_start_time < TIMESTAMP '{CUT}'")
def expired_versions(spark, d):
    return R.expired_ctids(X.ledger(spark, d), F.lit(CUT).cast("timestamp"), "version")


@query("SELECT user_id AS feed, 'f' || event_type || '_' || (event_id % 50) || '.txt' AS name, event_id % 50 AS ctid FROM events WHERE event_id % 50 < user_id % 20 AND event_id % 3 = 0")
def expired_files(spark, d):
    """Staged files of several feeds; each feed has expired ctids of its own."""
    e = table(spark, d, "events")
    names = e.selectExpr("user_id feed", "concat('f', event_type, '_', event_id % 50, if(event_id % 3 = 0, '.txt', '.tmp')) name")
    expired = e.select("user_id").distinct().selectExpr("user_id feed", "explode(sequence(0, 49)) n").where("n < feed % 20").selectExpr("feed", "cast(n as bigint) ctid")
    return R.drop_expired(names, expired, ".txt")


@query("SELECT 'tblCT' || event_type || '_' || event_id AS name, event_id AS ctid FROM events WHERE event_id IN (SELECT event_id FROM events WHERE value < 3) AND user_id % 2 = 0")
def drop_expired(spark, d):
    e = table(spark, d, "events")
    names = e.selectExpr("concat('tblCT', event_type, if(user_id % 2 = 0, '_', ''), event_id) name")
    return R.drop_expired(names, e.where("value < 3").selectExpr("event_id ctid"))


@query(LEDGER + f"SELECT * FROM subscribers WHERE coalesce(sync_stop_time, sync_start_time) >= TIMESTAMP '{CUT}'")
def trim_ledger(spark, d):
    return R.trim_ledger(X.subscribers(spark, d), F.lit(CUT).cast("timestamp"), "subscriber")


@query(EVENTS + f"SELECT * FROM events_log WHERE ts >= TIMESTAMP '{CUT}'")
def trim_log(spark, d):
    return R.trim_log(X.events_log(spark, d), F.lit(CUT).cast("timestamp"))


ERRORS = "errors AS (SELECT event_id AS id, 'user ' || user_id AS headers, CASE WHEN user_id % 3 = 0 THEN 'Table: t' || user_id || chr(10) || props || chr(10) || event_id ELSE props END AS message, ts AS log_date, event_id % 2 = 0 AS sent FROM events WHERE event_type = 'error')"


def _errors(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").selectExpr(
        "event_id id", "concat('user ', user_id) headers", "if(user_id % 3 = 0, concat('Table: t', user_id, '\\n', props, '\\n', event_id), props) message", "ts log_date", "event_id % 2 = 0 sent"
    )


@query(
    f"""WITH {ERRORS}, s AS (SELECT CAST(log_date AS DATE) AS day, log_date, CASE WHEN message LIKE 'Table:%' THEN split_part(message, chr(10), 1) || chr(10) || split_part(message, chr(10), 2) ELSE message END AS message FROM errors WHERE NOT sent)
SELECT day, message, count(*) AS n, max(log_date) AS newest FROM s GROUP BY 1, 2"""
)
def error_digest(spark, d):
    return M.error_digest(_errors(spark, d))


@query(
    f"""WITH {ERRORS}, s AS (SELECT CAST(log_date AS DATE) AS day, log_date, CASE WHEN message LIKE 'Table:%' THEN split_part(message, chr(10), 1) || chr(10) || split_part(message, chr(10), 2) ELSE message END AS message FROM errors WHERE NOT sent)
SELECT max(log_date) AS newest, day || ' x ' || count(*) || chr(10) || message AS block FROM s GROUP BY day, message"""
)
def digest_text(spark, d):
    return M.digest_text(M.error_digest(_errors(spark, d)))


@query(f"WITH {ERRORS} SELECT * EXCLUDE (sent), sent OR id % 3 = 0 AS sent FROM errors")
def mark_sent(spark, d):
    rows = _errors(spark, d)
    return M.mark_sent(rows, rows.where("id % 3 = 0"))


@query("SELECT event_id AS id, 'agent: Master; server: s; database: d' AS headers, props AS message, ts AS log_date, false AS sent FROM events WHERE event_type = 'error'")
def log_errors(spark, d):
    return M.log_errors(table(spark, d, "events").selectExpr("event_id id", "event_type level", "props message", "ts log_date"), "Master", "s", "d")


@query(
    LEDGER
    + """SELECT l.feed, s.subscriber, l.ctid, l.sync_stop_version - l.sync_start_version AS versions, date_diff('minute', l.sync_start_time, s.sync_stop_time) AS lag_minutes
FROM ledger l JOIN subscribers s ON l.feed = s.feed AND l.ctid = s.ctid WHERE s.sync_stop_time IS NOT NULL"""
)
def step_metrics(spark, d):
    return M.step_metrics(X.ledger(spark, d), X.subscribers(spark, d))


@query(
    """SELECT user_id AS feed, event_id % 7 AS ctid, event_type AS step, count(*) AS runs, CAST(sum(1000 * (event_id % 90) + 5) AS BIGINT) AS millis, arg_max(event_id % 11, ts) AS rows
FROM events GROUP BY 1, 2, 3"""
)
def step_durations(spark, d):
    steps = table(spark, d, "events").selectExpr("user_id feed", "event_id % 7 ctid", "event_type step", "ts began", "ts + make_dt_interval(0, 0, 0, event_id % 90 + 0.005) ended", "event_id % 11 rows")
    return M.step_durations(steps)


# schemas -------------------------------------------------------------------------------------------


def _events_xml(spark, d):
    """One ALTER TABLE or RENAME event per part."""
    names = "concat('<Name>', replace(p_brand, '#', ''), '</Name>')"
    body = f"""case when p_size % 5 = 4 then concat('<EventType>RENAME</EventType><SchemaName>dbo</SchemaName><ObjectName>', replace(p_brand, '#', ''),
      '</ObjectName><ObjectType>COLUMN</ObjectType><TargetObjectName>', p_type, '</TargetObjectName><NewObjectName>n', p_size, '</NewObjectName>')
      when p_size % 5 = 3 then '<EventType>CREATE_TABLE</EventType>'
      else concat('<EventType>ALTER_TABLE</EventType><SchemaName>dbo</SchemaName><ObjectName>', p_type, '</ObjectName><AlterTableActionList>',
      element_at(array(concat('<Create><Columns>', {names}, '<Name>extra</Name></Columns></Create>'), concat('<Alter><Columns>', {names}, '</Columns></Alter>'), concat('<Drop><Columns>', {names}, '</Columns></Drop>')), cast(p_size % 5 + 1 as int)),
      '</AlterTableActionList>') end"""
    return table(spark, d, "part").selectExpr("p_partkey id", "timestamp '2024-01-01' ts", f"concat('<EVENT_INSTANCE>', {body}, '</EVENT_INSTANCE>') xml")


DDL = """e AS (
  SELECT p_partkey AS event_id, 'dbo' AS schema_name, p_type AS table_name, CASE p_size % 5 WHEN 0 THEN 'Add' WHEN 1 THEN 'Modify' WHEN 2 THEN 'Drop' ELSE 'Rename' END AS event_type,
         replace(p_brand, '#', '') AS column_name, CASE WHEN p_size % 5 = 4 THEN 'n' || p_size END AS new_column_name FROM part WHERE p_size % 5 <> 3
  UNION ALL SELECT p_partkey, 'dbo', p_type, 'Add', 'extra', NULL FROM part WHERE p_size % 5 = 0)"""


@query(f"WITH {DDL} SELECT * FROM e")
def parse_ddl_events(spark, d):
    return S.parse_ddl_events(_events_xml(spark, d)).drop("ts")


@query(f"WITH {DDL} SELECT * FROM e WHERE table_name = 'ECONOMY' OR (table_name = 'STANDARD' AND lower(column_name) IN ('brand1', 'brand2', 'extra'))")
def applicable_changes(spark, d):
    specs = [TableSpec("economy"), TableSpec("Standard", columns=("brand1", "Brand2", "extra"))]
    return S.parse_ddl_events(_events_xml(spark, d), specs).drop("ts")


@query(
    f"""WITH {DDL}, c AS (SELECT p_type AS table_name, lower(replace(p_brand, '#', '')) AS column_name, max(p_size) AS length FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1, 2)
SELECT e.*, c.length, CASE WHEN c.length IS NOT NULL THEN 'varchar' END AS data_type FROM e LEFT JOIN c ON e.event_type IN ('Add', 'Modify') AND c.table_name = e.table_name AND c.column_name = lower(e.column_name)
WHERE e.event_type NOT IN ('Add', 'Modify') OR c.length IS NOT NULL"""
)
def attach_types(spark, d):
    listing = table(spark, d, "part").where("p_brand <> 'Brand#3'").groupBy(F.lit("dbo").alias("schema_name"), F.col("p_type").alias("table_name"), F.expr("replace(p_brand, '#', '')").alias("column_name"))
    types = listing.agg(F.max("p_size").alias("length")).select("*", F.lit("varchar").alias("data_type"), F.lit(None).cast("int").alias("precision"), F.lit(None).cast("int").alias("scale"))
    return S.publish_schema_changes(_events_xml(spark, d), types, _part_types(spark, d), F.lit("2023-12-31").cast("timestamp")).drop("ts", "precision", "scale")


def _part_types(spark, d):
    """The tables subscribed here: all type names of ``part``."""
    return table(spark, d, "part").select(F.lit("dbo").alias("schema_name"), F.col("p_type").alias("table_name")).distinct()


@query(
    """WITH a AS (SELECT p_type AS table_name, p_partkey AS c, 'int' AS t FROM part WHERE p_size > 5), b AS (SELECT p_type AS table_name, p_partkey AS c, CASE WHEN p_size > 40 THEN 'bigint' ELSE 'int' END AS t FROM part WHERE p_size < 45)
SELECT 'dbo' AS schema_name, coalesce(a.table_name, b.table_name) AS table_name, 'c' || coalesce(a.c, b.c) AS column_name, CASE WHEN b.c IS NULL THEN 'Drop' WHEN a.c IS NULL THEN 'Add' ELSE 'Modify' END AS event_type, b.t AS column_type
FROM a FULL JOIN b ON a.table_name = b.table_name AND a.c = b.c WHERE (a.c IS NULL OR b.c IS NULL OR a.t <> b.t) AND coalesce(a.table_name, b.table_name) IN (SELECT table_name FROM a)"""
)
def diff_schemas(spark, d):
    rows = table(spark, d, "part").selectExpr("'dbo' schema_name", "p_type table_name", "concat('c', p_partkey) column_name", "p_size", "if(p_size > 40, 'bigint', 'int') t")
    key = ["schema_name", "table_name", "column_name"]
    return S.diff_schemas(rows.where("p_size > 5").select(*key, F.lit("int").alias("column_type")), rows.where("p_size < 45").select(*key, F.col("t").alias("column_type")))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment AS c_segment, CAST(NULL AS INTEGER) AS c_tier FROM customer")
def evolve(spark, d):
    steps = [
        {"event_type": "Drop", "column_name": "C_ACCTBAL"},
        {"event_type": "Add", "column_name": "c_tier", "data_type": "int"},
        {"event_type": "Modify", "column_name": "c_nationkey", "data_type": "bigint"},
        {"event_type": "Rename", "column_name": "c_mktsegment", "new_column_name": "c_segment"},
    ]
    return S.evolve(table(spark, d, "customer"), steps + steps[:3])


#: A mapping file as users write it: the databases' names, then a type of each in a line.
MAPPING_FILE = ["MSSQL\tNetezza", "bit\tbyteint", "datetime\ttimestamp", "float\tdouble precision", "money\tdecimal(20,4)", "text\tvarchar(500)", "varbinary\tvarchar(100)"]
TYPED = """(SELECT p_partkey, ['bit', 'varchar', 'nchar', 'text', 'money', 'decimal', 'datetime', 'float', 'varbinary', 'int'][1 + p_partkey % 10] AS data_type,
  CASE WHEN p_size % 9 = 0 THEN -1 WHEN p_size % 7 <> 0 THEN p_size * 400 END AS length, p_size % 30 + 1 AS precision, p_size % 5 AS scale, CASE WHEN p_size % 4 = 1 THEN 7 END AS modifier FROM part)"""
MAPPED = """(SELECT *, CASE data_type WHEN 'bit' THEN 'byteint' WHEN 'datetime' THEN 'timestamp' WHEN 'float' THEN 'double precision' WHEN 'money' THEN 'decimal(20,4)'
  WHEN 'text' THEN 'varchar(500)' WHEN 'varbinary' THEN 'varchar(100)' ELSE data_type END AS mapped FROM """ + TYPED + ")"


def _typed(spark, d):
    names = "array('bit', 'varchar', 'nchar', 'text', 'money', 'decimal', 'datetime', 'float', 'varbinary', 'int')"
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", f"element_at({names}, cast(1 + p_partkey % 10 as int)) data_type", "case when p_size % 9 = 0 then -1 when p_size % 7 <> 0 then p_size * 400 end length",
        "p_size % 30 + 1 precision", "p_size % 5 scale", "case when p_size % 4 = 1 then 7 end modifier",
    )
    path = scratch(spark, "mapping")
    spark.createDataFrame([(x,) for x in MAPPING_FILE], "value string").coalesce(1).write.text(path)
    return T.map_types(rows, T.read_mapping(spark, path), "mssql", "NETEZZA")


@query(f"SELECT * FROM {MAPPED}")
def map_types(spark, d):
    return _typed(spark, d)


@query(
    f"""SELECT p_partkey, CASE WHEN data_type = 'text' AND modifier = 7 THEN 'varchar(7)' WHEN data_type = 'varbinary' AND modifier = 7 THEN 'varchar(7)' WHEN mapped <> data_type THEN mapped
  WHEN data_type IN ('varchar', 'nchar') THEN CASE WHEN modifier = 7 THEN data_type || '(7)' WHEN length IS NULL THEN data_type WHEN length < 1 OR length > 8000 THEN data_type || '(8000)' ELSE data_type || '(' || length || ')' END
  WHEN data_type = 'decimal' THEN 'decimal(' || precision || ',' || scale || ')' ELSE data_type END AS target FROM {MAPPED}"""
)
def target_type(spark, d):
    return T.target_type(_typed(spark, d), "netezza", 8000).select("p_partkey", "target")


@query(
    f"""SELECT p_partkey, CASE WHEN modifier = 7 AND mapped IN ('varchar(500)', 'varchar(100)') THEN 'varchar(7)' WHEN modifier = 7 THEN mapped || '(7)'
  WHEN data_type IN ('varchar', 'nchar', 'varbinary') AND length IS NOT NULL THEN mapped || '(' || CASE WHEN length = -1 OR length > 8000 THEN 8000 ELSE length END || ')'
  WHEN data_type IN ('decimal', 'money') THEN mapped || '(' || precision || ', ' || scale || ')' ELSE mapped END AS target FROM {MAPPED}"""
)
def target_type_vertica(spark, d):
    return T.target_type(_typed(spark, d), "vertica", 8000).select("p_partkey", "target")


@query(
    f"""SELECT p_partkey, CASE WHEN modifier = 7 AND data_type IN ('text', 'varbinary') THEN 'varchar(7)' WHEN mapped <> data_type THEN mapped
  WHEN data_type IN ('varchar', 'nchar') THEN CASE WHEN modifier = 7 THEN data_type || '(7)' WHEN length = -1 THEN 'longtext' WHEN length IS NULL THEN data_type ELSE data_type || '(' || length || ')' END
  WHEN data_type = 'decimal' THEN 'decimal(' || precision || ',' || scale || ')' ELSE data_type END AS target FROM {MAPPED}"""
)
def target_type_mysql(spark, d):
    return T.target_type(_typed(spark, d), "mysql").select("p_partkey", "target")


@query(
    f"""SELECT p_partkey, CASE WHEN data_type IN ('varchar', 'nchar', 'text') THEN data_type || '(' || CASE WHEN length < 8000 THEN CAST(length AS VARCHAR) ELSE 'MAX' END || ')'
  WHEN data_type IN ('decimal', 'float') THEN data_type || '(' || precision || ',' || scale || ')' ELSE data_type END AS target FROM {TYPED}"""
)
def target_type_mssql(spark, d):
    return T.target_type(_typed(spark, d).withColumn("mapped", F.col("data_type")), "mssql").select("p_partkey", "target")


@query("SELECT doc_id, left(text, 40) AS text, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def conform(spark, d):
    return T.conform(table(spark, d, "documents").select("doc_id", "text", "n_chars"), {"text": "varchar(40)", "n_chars": "int"})


@query(
    """WITH c AS (SELECT p_partkey AS t, lower(replace(p_brand, '#', '')) AS column_name, p_size FROM part)
SELECT DISTINCT 'vw' || 'C' || t AS view_name, 'TBLC' || t AS table_name FROM c WHERE p_size % 3 <> 0"""
)
def views_to_refresh(spark, d):
    part = table(spark, d, "part")
    changes = part.selectExpr("concat('tblc', p_partkey) table_name", "replace(p_brand, '#', '') column_name", "'Add' event_type")
    own = part.selectExpr("concat('TBLC', p_partkey) table_name", "replace(p_brand, '#', '') column_name")
    archive = part.selectExpr("concat('TBLC', p_partkey, 'Archive') table_name", "if(p_size % 3 = 0, 'other', replace(p_brand, '#', '')) column_name")
    return S.views_to_refresh(changes, part.selectExpr("concat('vwC', p_partkey) view_name"), own.unionByName(archive))


@query(
    """SELECT 'dbo' AS schema_name, 'T' || p_type AS table_name, 'c' || p_partkey AS column_name, p_size > 45 AS is_pk FROM part"""
)
def pk_columns(spark, d):
    rows = table(spark, d, "part").selectExpr("'dbo' schema_name", "concat('T', p_type) table_name", "concat('c', p_partkey) column_name", "p_size")
    usage = rows.where("p_size > 40").selectExpr("schema_name", "table_name", "column_name", "if(p_size > 45, 'pk', 'fk') constraint_name")
    kinds = rows.selectExpr("schema_name", "table_name", "explode(array('pk', 'fk')) constraint_name").distinct()
    kinds = kinds.withColumn("constraint_type", F.when(F.col("constraint_name") == "pk", "Primary Key").otherwise("FOREIGN KEY"))
    return S.pk_columns(rows.drop("p_size"), usage, kinds)


@query(orders_sql() + "SELECT count(*) FILTER (_op <> 'D') AS inserted, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM orders_before)) AS deleted FROM changes")
def total_applied(spark, d):
    """Counts taken while a table and its archive are merged, summed."""
    root, rows = scratch(spark, "counts"), []
    changes, old = changes_of_orders(spark, d), F.col("o_orderkey") % 2 == 0
    for name, part in (("Orders", ~old), ("OrdersArchive", old)):
        spec = TableSpec(name, ("o_orderkey",))
        store.initial_load(X.orders_before(spark, d).where(part), spec, root, buckets=4)
        rows.append((name, *(lambda x: (x.inserted, x.deleted))(store.apply_to_buckets(spark, changes.where(part), spec, root))))
    return N.total_applied(spark.createDataFrame(rows, "table_name string, inserted long, deleted long"))


# stores and files ----------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def write_with_layout(spark, d):
    path = scratch(spark, "layout")
    store.write_with_layout(table(spark, d, "orders"), path, X.ORDERS)
    return spark.read.parquet(path).drop("_bucket")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def read_snapshot(spark, d):
    path = scratch(spark, "snapshot")
    store.write_with_layout(table(spark, d, "orders"), path, X.ORDERS, "random", 3)
    return store.read_snapshot(spark, path, TableSpec("orders", ("o_orderkey",), ("o_totalprice",)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderkey % 100 = 0")
def reinitialize(spark, d):
    """A target loaded anew with far fewer rows, and without one of its columns."""
    root, rows = scratch(spark, "load"), table(spark, d, "orders")
    store.initial_load(rows, X.ORDERS, root, buckets=16)
    store.initial_load(rows.where("o_orderkey % 100 = 0").drop("o_orderpriority"), X.ORDERS, root, "reinitialize", buckets=16)
    return store.read_target(spark, root, X.ORDERS)


@query(orders_sql() + "SELECT * FROM orders_now")
def apply_group_retry(spark, d):
    """A first attempt writes other rows and fails before its pointer; the second one counts."""
    root, spec = scratch(spark, "group"), X.ORDERS
    store.initial_load(X.orders_before(spark, d), spec, root, buckets=16)
    wrong = X.orders_before(spark, d).withColumns({VERSION: F.lit(1).cast("long"), OP: F.lit("U"), "o_orderstatus": F.lit("?")})
    store.rewrite(spark, root, spec, wrong, store.target(spark, root, spec.name))
    store.apply_group(spark, root, [(spec, changes_of_orders(spark, d))])
    store.vacuum(spark, root)
    return store.read_target(spark, root, spec)


@query(EVENTS + "SELECT ctid AS CTHistID, k, value, version AS _version, op AS _op FROM batches")
def append_history(spark, d):
    root, rows = scratch(spark, "history"), _batches(spark, d).selectExpr("ctid", "k", "value", "version _version", "op _op")
    for ctid in (1, 2, 3, 4, 5, 2):  # the second is applied twice
        store.append_history(rows.where(F.col("ctid") == ctid).drop("ctid"), ctid, root, "events")
    return store.read_history(spark, root, "events").select(F.col("CTHistID").cast("long").alias("CTHistID"), "k", "value", VERSION, OP)


@query(orders_sql() + "SELECT * FROM changes")
def copy_change_sets(spark, d):
    a, b = scratch(spark, "relay"), scratch(spark, "slave")
    store.write_change_set(changes_of_orders(spark, d), a, "Orders", 7)
    store.copy_change_sets(spark, a, b, [("orders", 1), ("other", 1), ("empty", 0)], 7)
    return store.read_change_set(spark, b, "ORDERS", 7)


@query("SELECT c_custkey, left(c_name, 5) AS c_name, c_nationkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey, left(c_name, 5), c_nationkey FROM customer WHERE c_nationkey >= 10")
def initial_load(spark, d):
    root, spec = scratch(spark, "load"), TableSpec("customer", ("c_custkey",), ("c_name", "c_nationkey"), shorten={"c_name": 5})
    base = table(spark, d, "customer")
    store.initial_load(base.where("c_nationkey < 10"), spec, root)
    store.initial_load(base.where("c_nationkey >= 10"), spec, root, "append")
    return store.read_target(spark, root, spec)


@query("SELECT doc_id, coalesce(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(13) || chr(10), ' '), '\"', chr(92) || '\"'), '|', ','), chr(10), ' '), 'NULL', chr(92) || 'NULL'), 'NULL') AS text FROM documents")
def escape_texts(spark, d):
    return escape_text(table(spark, d, "documents").select("doc_id", "text"), "netezza")


@query("SELECT event_id, user_id, event_type, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '' ELSE props END AS props FROM events")
def delimited_round_trip(spark, d):
    path = scratch(spark, "delimited")
    rows = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "case when user_id % 7 = 0 then null when user_id % 7 = 1 then '' else props end props")
    delimited.write_delimited(rows, path, delimited.MYSQL)
    return delimited.read_delimited(spark, path, rows.schema, delimited.MYSQL)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def delimited_strict(spark, d):
    path, rows = scratch(spark, "strict"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    delimited.write_delimited(rows, path, delimited.STRICT)
    return delimited.read_strict(spark, path, rows.schema)


@query("SELECT o_orderkey, o_custkey, left(o_orderpriority, 4) AS o_orderpriority, CAST(NULL AS VARCHAR) AS o_clerk FROM orders")
def delimited_tolerant(spark, d):
    path, rows = scratch(spark, "tolerant"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    delimited.write_delimited(rows, path, delimited.Dialect())
    schema = rows.withColumn("o_clerk", F.lit(None).cast("string")).schema
    return delimited.read_tolerant(spark, path, schema, {"o_orderpriority": 4})


@query(orders_sql() + "SELECT * FROM orders_now")
def publish_and_apply(spark, d):
    """Two batches published, then applied as one: the whole flow."""
    from tidemark.plans.pipeline import apply_batch, publish

    relay, root, spec = scratch(spark, "relay"), scratch(spark, "slave"), TableSpec("orders", ("o_orderkey",), history=True)
    source = {"orders": (X.orders_log(spark, d), X.orders_now(spark, d))}
    store.initial_load(X.orders_before(spark, d), spec, root)
    publish(spark, source, [spec], relay, 1, 0, 5_000_000)
    publish(spark, source, [spec], relay, 2, 5_000_000, 10**12)
    apply_batch(spark, [spec], relay, root, [1, 2])
    return store.read_target(spark, root, spec)


def _published(spark, d, specs, stops=(5_000_000, 10**12)):
    """A relay with the orders log published in batches 1, 2, ... up to these versions."""
    from tidemark.plans.pipeline import publish

    relay = scratch(spark, "relay")
    for n, (low, high) in enumerate(zip((0, *stops), stops, strict=False), 1):
        publish(spark, {"orders": (X.orders_log(spark, d), X.orders_now(spark, d))}, specs, relay, n, low, high)
    return relay


@query(orders_sql() + "SELECT 'now' AS part, * FROM orders_now UNION ALL SELECT 'history', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM changes")
def resume_apply(spark, d):
    """A run that stops after the download, and is resumed; steps done are not done again."""
    from tidemark.functions import COMPLETE, DOWNLOAD
    from tidemark.plans.pipeline import apply_batch

    spec = TableSpec("orders", ("o_orderkey",), history=True)
    relay, root = _published(spark, d, [spec]), scratch(spark, "slave")
    store.initial_load(X.orders_before(spark, d), spec, root)
    apply_batch(spark, [spec], relay, root, [1, 2], until=DOWNLOAD)
    store.delete_change_sets(spark, relay, spark.createDataFrame([(1,), (2,)], "ctid long"))  # the download isn't repeated
    apply_batch(spark, [spec], relay, root, [1, 2])
    bits = store.read_ledger(spark, root, "subscriber").where(F.col("sync_bitwise") == COMPLETE).count()
    now = store.read_target(spark, root, spec).select(F.lit("now").alias("part"), "*")
    past = store.read_history(spark, root, "orders").drop(VERSION, OP, "CTHistID").select(F.lit("history").alias("part"), "*")
    return now.unionByName(past).where(F.lit(bits == 2))


@query(
    orders_sql(0, 5_000_000)
    + """, half AS (SELECT b.* FROM orders_before b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM changes WHERE _op <> 'D')
SELECT 'slow' AS subscriber, * FROM half UNION ALL SELECT 'fast', * FROM orders_now"""
)
def independent_subscribers(spark, d):
    """One subscriber has applied both batches, another one only the first."""
    from tidemark.plans.pipeline import apply_batch

    relay, parts = _published(spark, d, [X.ORDERS]), []
    for name, ctids in (("fast", [1, 2]), ("slow", [1])):
        root = scratch(spark, name)
        store.initial_load(X.orders_before(spark, d), X.ORDERS, root)
        apply_batch(spark, [X.ORDERS], relay, root, ctids)
        parts.append(store.read_target(spark, root, X.ORDERS).select(F.lit(name).alias("subscriber"), "*"))
    return parts[0].unionByName(parts[1])


@query(
    orders_sql()
    + """SELECT 'now' AS part, o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority AS o_rank, CAST(NULL AS INTEGER) AS o_extra FROM orders_now
UNION ALL SELECT 'history', l.o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE), o_orderdate, o_orderpriority, NULL
  FROM (SELECT DISTINCT o_orderkey, version > 5000000 AS later FROM orders_log) l LEFT JOIN orders_now n ON l.o_orderkey = n.o_orderkey"""
)
def schema_changes_in_flow(spark, d):
    """Between two batches a column is renamed and one is added; targets and history follow."""
    from tidemark.plans.pipeline import apply_batch, publish

    relay, root, spec = scratch(spark, "relay"), scratch(spark, "slave"), TableSpec("orders", ("o_orderkey",), history=True)
    log, now = X.orders_log(spark, d), X.orders_now(spark, d)
    store.initial_load(X.orders_before(spark, d), spec, root)
    publish(spark, {"orders": (log.where("version <= 5000000"), now)}, [spec], relay, 1, 0, 5_000_000)
    apply_batch(spark, [spec], relay, root, [1])
    xml = "<EVENT_INSTANCE><EventType>{}</EventType><SchemaName>dbo</SchemaName><ObjectName>{}</ObjectName>{}</EVENT_INSTANCE>"
    events = [
        (1, xml.format("RENAME", "o_orderpriority", "<ObjectType>COLUMN</ObjectType><TargetObjectName>orders</TargetObjectName><NewObjectName>o_rank</NewObjectName>")),
        (2, xml.format("ALTER_TABLE", "orders", "<AlterTableActionList><Create><Columns><Name>o_extra</Name></Columns></Create></AlterTableActionList>")),
    ]
    ddl = spark.createDataFrame(events, "id int, xml string").withColumn("ts", F.expr("current_timestamp() + interval 1 hour"))
    types = spark.createDataFrame([("dbo", "orders", "o_extra", "int")], "schema_name string, table_name string, column_name string, data_type string")
    types = types.withColumns({c: F.lit(None).cast("int") for c in ("length", "precision", "scale")})
    later = now.withColumnRenamed("o_orderpriority", "o_rank").withColumn("o_extra", F.lit(None).cast("int"))
    publish(spark, {"orders": (log, later)}, [spec], relay, 2, 5_000_000, 10**12, ddl, types)
    apply_batch(spark, [spec], relay, root, [2])
    a = store.read_target(spark, root, spec).select(F.lit("now").alias("part"), "*")
    b = store.read_history(spark, root, "orders").drop(VERSION, OP, "CTHistID").select(F.lit("history").alias("part"), "*")
    return a.unionByName(b).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(orders_sql(5_000_000) + "SELECT * FROM changes")
def retire(spark, d):
    """Old batches are deleted from the relay; the one that is left is still there."""
    from tidemark.plans.pipeline import retire

    relay = _published(spark, d, [X.ORDERS])
    rows = store.read_ledger(spark, relay, "publisher").withColumn("sync_start_time", F.when(F.col("ctid") == 1, F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("sync_start_time")))
    store.record(spark, relay, "publisher", spark.createDataFrame(rows.collect(), rows.schema))
    gone = retire(spark, relay, F.lit("2002-01-01").cast("timestamp"))
    left = [c for c in (1, 2) if store.read_change_set(spark, relay, "orders", c) is not None]
    return store.read_change_set(spark, relay, "orders", 2).where(F.lit(left == [2] and len(gone) > 1))


@query(
    orders_sql()
    + """, c AS (SELECT * FROM changes WHERE o_orderkey % 4 < 3)
SELECT * REPLACE (CASE WHEN o_orderkey % 4 = 1 AND _op <> 'D' THEN 'first' ELSE o_orderstatus END AS o_orderstatus) FROM c"""
)
def merge_batch(spark, d):
    """Change sets of two shards that overlap in a quarter of the keys: the first shard counts."""
    from tidemark.plans.pipeline import merge_batch

    shards = [("one", scratch(spark, "one")), ("two", scratch(spark, "two"))]
    root, changes = scratch(spark, "merged"), changes_of_orders(spark, d)
    store.write_change_set(changes.where("o_orderkey % 4 in (0, 1)").withColumn("o_orderstatus", F.expr("if(o_orderkey % 4 = 1 and _op <> 'D', 'first', o_orderstatus)")), shards[0][1], "orders", 3)
    store.write_change_set(changes.where("o_orderkey % 4 in (1, 2)"), shards[1][1], "orders", 3)
    merge_batch(spark, [X.ORDERS], shards, root, 3)
    return store.read_change_set(spark, root, "orders", 3)


@query(EVENTS + "SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM events_log) WHERE n = 1 AND op <> 'D'")
def stream_apply(spark, d):
    """The events log as a stream of files, late rows included, merged batch by batch."""
    from tidemark.streaming import live, stream_apply

    source, root = scratch(spark, "stream"), scratch(spark, "target")
    rows = X.change_rows(spark, d)
    rows.repartitionByRange(4, F.pmod(F.col(VERSION), F.lit(4))).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    spec = TableSpec("events", ("k",))
    stream_apply(stream, root, spec, f"{root}/checkpoint").awaitTermination()
    return live(store.read_target(spark, root, spec))


@query(EVENTS + "SELECT op AS _op, count(*) AS n FROM events_log GROUP BY 1")
def consume(spark, d):
    """Change rows of a stream handed to user code, which counts them by operation."""
    from tidemark.streaming import consume

    source, out = scratch(spark, "stream"), scratch(spark, "counts")
    rows = X.change_rows(spark, d)
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    count = lambda batch, n: batch.groupBy(OP).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}")
    consume(stream, count, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).groupBy(OP).agg(F.sum("n").alias("n"))


from tidemark.plans import flow_queries as _flow_queries  # noqa: E402, F401  registers its queries
