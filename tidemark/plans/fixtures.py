"""Change data derived from the driver tables by exact expressions, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.paths import table
from tidemark.spec import TableSpec

ORDERS = TableSpec("orders", ("o_orderkey",))
CUSTOMER = TableSpec("customer", ("k",))

ORDERS_SQL = """
orders_before AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 9),
orders_log AS (
  SELECT o_orderkey, 1000 + o_orderkey AS version,
         CASE WHEN o_orderkey % 10 = 9 THEN 'I' WHEN o_orderkey % 10 = 3 THEN 'D' ELSE 'U' END AS op
  FROM orders WHERE o_orderkey % 10 IN (1, 2, 3, 9)
  UNION ALL SELECT o_orderkey, 10000000 + o_orderkey, 'U' FROM orders WHERE o_orderkey % 20 IN (1, 9)),
orders_now AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 IN (1, 2) THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 20 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 10 <> 3),
net AS (
  SELECT o_orderkey, max(version) AS _version, max(CASE WHEN op = 'I' THEN version END) AS created,
         CASE WHEN arg_max(op, version) = 'D' THEN 'D' WHEN max(CASE WHEN op = 'I' THEN version END) IS NOT NULL THEN 'I' ELSE 'U' END AS _op
  FROM orders_log WHERE version > {start} GROUP BY o_orderkey),
changes AS (
  SELECT n.o_orderkey, b.o_custkey, b.o_orderstatus, b.o_totalprice, b.o_orderdate, b.o_orderpriority, n._version, n._op
  FROM net n LEFT JOIN orders_now b ON n.o_orderkey = b.o_orderkey
  WHERE (n._version <= {stop} OR n.created <= {stop}) AND (n._op = 'D' OR b.o_orderkey IS NOT NULL))
"""
ALL = {"start": 0, "stop": 10**12}

EVENTS_SQL = """
events_log AS (
  SELECT user_id AS k, event_id AS version, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op, value, ts FROM events),
batches AS (SELECT *, 1 + version * 5 // (SELECT 1 + max(version) FROM events_log) AS ctid FROM events_log)
"""

LEDGER_SQL = """
days AS (SELECT user_id AS feed, CAST(ts AS DATE) AS d, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1, 2),
ledger AS (
  SELECT feed, dense_rank() OVER (PARTITION BY feed ORDER BY d) AS ctid, a AS sync_start_version, b AS sync_stop_version, CAST(d AS TIMESTAMP) AS sync_start_time,
         CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR AS sync_stop_time, CASE WHEN day(d) % 5 = 0 THEN 3 ELSE 7 END AS sync_bitwise FROM days),
subscribers AS (
  SELECT feed, s.subscriber, ctid, sync_start_version, sync_stop_version, sync_start_time,
         CASE WHEN ctid <= s.upto THEN sync_stop_time END AS sync_stop_time, CASE WHEN ctid <= s.upto THEN 255 ELSE 15 END AS sync_bitwise
  FROM ledger, (VALUES ('a', 20), ('b', 12)) AS s(subscriber, upto) WHERE ctid <= s.upto + (feed % 3))
"""


def orders_before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 10 <> 9")


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    kind = "case when o_orderkey % 10 = 9 then 'I' when o_orderkey % 10 = 3 then 'D' else 'U' end op"
    first = o.where("o_orderkey % 10 in (1, 2, 3, 9)").selectExpr("o_orderkey", "1000 + o_orderkey version", kind)
    return first.unionAll(o.where("o_orderkey % 20 in (1, 9)").selectExpr("o_orderkey", "10000000 + o_orderkey version", "'U' op"))


def orders_now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 10 <> 3").selectExpr(
        "o_orderkey", "o_custkey", "if(o_orderkey % 10 in (1, 2), 'X', o_orderstatus) o_orderstatus",
        "if(o_orderkey % 20 = 1, o_totalprice + 1, o_totalprice) o_totalprice", "o_orderdate", "o_orderpriority",
    )


def events_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id k", "event_id version", "case event_type when 'error' then 'D' when 'signup' then 'I' else 'U' end op", "value", "ts"
    )


def change_rows(spark: SparkSession, d: str) -> DataFrame:
    """The events log in the shape of change rows."""
    return events_log(spark, d).selectExpr("k", "value", "version _version", "op _op")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.col("user_id").alias("feed"), F.to_date("ts").alias("d")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return days.selectExpr(
        "feed", "cast(dense_rank() over (partition by feed order by d) as bigint) ctid", "a sync_start_version", "b sync_stop_version",
        "cast(d as timestamp) sync_start_time", "cast(d as timestamp) + interval 1 hour sync_stop_time", "if(day(d) % 5 = 0, 3, 7) sync_bitwise",
    )


def subscribers(spark: SparkSession, d: str) -> DataFrame:
    each = ledger(spark, d).withColumn("s", F.explode(F.expr("array(named_struct('n', 'a', 'upto', 20), named_struct('n', 'b', 'upto', 12))")))
    return each.where("ctid <= s.upto + feed % 3").selectExpr(
        "feed", "s.n subscriber", "ctid", "sync_start_version", "sync_stop_version", "sync_start_time",
        "if(ctid <= s.upto, sync_stop_time, null) sync_stop_time", "if(ctid <= s.upto, 255, 15) sync_bitwise",
    )
