"""Registered queries of stored targets, kept runs and whole flows, with their DuckDB twins."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from tidemark.operators.consolidate import batch_numbers
from tidemark.plans import fixtures as X
from tidemark.plans.queries import EVENTS, NET, _published, changes_of_orders, orders_sql, query
from tidemark.sources import bucketed, jdbc, pointers, runs, store
from tidemark.sources.paths import scratch, table
from tidemark.spec import OP, VERSION, TableSpec

# stored targets ------------------------------------------------------------------------------------

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    f"""WITH t AS (SELECT {ORDER_COLUMNS}, CASE WHEN o_orderkey % 100 = 39 THEN 3 WHEN o_orderkey % 100 = 7 THEN 2 WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END AS turn FROM orders WHERE o_orderkey % 100 <> 15)
SELECT {ORDER_COLUMNS.replace("o_orderstatus", "CASE turn WHEN 0 THEN o_orderstatus ELSE CAST(turn AS VARCHAR) END AS o_orderstatus")}, NULL AS laid_beside FROM t
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true"""
)
def merge_on_read(spark, d):
    """Three small change sets laid beside the target's parts: updates, deletes, a key deleted and put
    back, another deleted twice; the target reads as if it had been rewritten."""
    root, o = scratch(spark, "beside"), table(spark, d, "orders")
    store.initial_load(o, X.ORDERS, root, buckets=4)
    before = store.target(spark, root, "orders")
    send = lambda rows, op, n: rows.withColumns({VERSION: F.lit(n).cast("long"), OP: F.lit(op), "o_orderstatus": F.lit(str(n))})
    part = lambda k: o.where(f"o_orderkey % 100 = {k}")
    for change in (
        send(part(1), "U", 1).unionByName(send(part(15), "D", 1)).unionByName(send(part(39), "D", 1)),
        send(part(7), "U", 2).unionByName(send(part(15), "D", 2)),
        send(part(39), "I", 3),
    ):
        store.apply_to_buckets(spark, change, X.ORDERS, root)
    after = store.target(spark, root, "orders")
    told = spark.createDataFrame([(after.places == before.places and len(after.deltas) > 0,)], "laid_beside boolean")
    return store.read_target(spark, root, X.ORDERS).withColumn("laid_beside", F.lit(None).cast("boolean")).unionByName(told, allowMissingColumns=True)


@query(orders_sql() + "SELECT *, NULL AS few_parts FROM orders_now UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true")
def apply_to_ranges(spark, d):
    """The merge into a target laid out by ranges of its key; a fiftieth of the keys, side by side, falls
    into few of its parts."""
    root = scratch(spark, "ranges")
    store.initial_load(X.orders_before(spark, d), X.ORDERS, root, buckets=64, layout="range")
    t = store.target(spark, root, "orders")
    low, n = X.orders_before(spark, d).agg(F.min("o_orderkey"), F.count(F.lit(1))).first()
    near = X.orders_before(spark, d).where(F.col("o_orderkey") < low + n // 50).select("o_orderkey")
    told = spark.createDataFrame([(len(store.touched_parts(t, near, X.ORDERS)) * 10 < t.buckets,)], "few_parts boolean")
    store.apply_to_buckets(spark, changes_of_orders(spark, d), X.ORDERS, root)
    return store.read_target(spark, root, X.ORDERS).withColumn("few_parts", F.lit(None).cast("boolean")).unionByName(told, allowMissingColumns=True)


@query(
    """SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority AS o_rank, CASE WHEN o_orderkey % 25 = 0 THEN 'new' END AS o_orderstatus, NULL AS rows_written FROM orders
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, false"""
)
def evolve_target(spark, d):
    """A column renamed, one dropped, and one added under the dropped one's name, without writing a row;
    then changes of the new columns are applied."""
    root, o = scratch(spark, "columns"), table(spark, d, "orders")
    store.initial_load(o, X.ORDERS, root, buckets=4)
    before = store.target(spark, root, "orders")
    steps = [
        {"event_type": "Rename", "column_name": "o_orderpriority", "new_column_name": "o_rank"},
        {"event_type": "Drop", "column_name": "o_orderstatus"},
        {"event_type": "Add", "column_name": "o_orderstatus", "data_type": "varchar"},
    ]
    store.evolve_target(spark, root, X.ORDERS, steps)
    after = store.target(spark, root, "orders")
    told = spark.createDataFrame([(after.places != before.places,)], "rows_written boolean")
    changed = o.where("o_orderkey % 25 = 0").withColumnRenamed("o_orderpriority", "o_rank").withColumns({"o_orderstatus": F.lit("new"), VERSION: F.lit(1).cast("long"), OP: F.lit("U")})
    store.apply_to_buckets(spark, changed, X.ORDERS, root)
    now = store.read_target(spark, root, X.ORDERS).withColumns({"o_totalprice": F.col("o_totalprice").cast("double"), "rows_written": F.lit(None).cast("boolean")})
    return now.unionByName(told, allowMissingColumns=True)


def _stored(spark, d, method):
    root, spec = scratch(spark, method), TableSpec("orders", ("o_orderkey",), method=method)
    store.initial_load(X.orders_before(spark, d), spec, root, buckets=4)
    sent = changes_of_orders(spark, d).drop("o_orderpriority")
    did = store.apply_to_buckets(spark, sent, spec, root)
    return store.read_target(spark, root, spec).select(F.lit(method).alias("method"), "*", F.lit(None).cast("long").alias("inserted"), F.lit(None).cast("long").alias("deleted")).unionByName(
        spark.createDataFrame([(method, did.inserted, did.deleted)], "method string, inserted long, deleted long"), allowMissingColumns=True
    )


@query(
    orders_sql()
    + """, kept AS (SELECT * FROM orders_before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)),
new AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM changes WHERE _op <> 'D'),
n AS (SELECT (SELECT count(*) FROM new) AS i, (SELECT count(*) FROM orders_before WHERE o_orderkey IN (SELECT o_orderkey FROM changes)) AS x)
SELECT 'delete_insert' AS method, *, NULL AS inserted, NULL AS deleted FROM kept UNION ALL SELECT 'delete_insert', *, NULL, NULL, NULL FROM new
UNION ALL SELECT 'replace', *, NULL, NULL FROM kept UNION ALL SELECT 'replace', *, NULL, NULL, NULL FROM new
UNION ALL SELECT 'delete_insert', NULL, NULL, NULL, NULL, NULL, NULL, i, x FROM n UNION ALL SELECT 'replace', NULL, NULL, NULL, NULL, NULL, NULL, i, x FROM n"""
)
def apply_methods(spark, d):
    """Delete-and-insert and replace on stored targets, with what they did; a column isn't sent."""
    return _stored(spark, d, "delete_insert").unionByName(_stored(spark, d, "replace"))


@query(f"SELECT {ORDER_COLUMNS.replace('o_orderstatus', 'CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE o_orderstatus END AS o_orderstatus')} FROM orders")
def two_writers(spark, d):
    """Two appliers at once, whose changes fall into the same parts: neither loses rows."""
    root, o, failed = scratch(spark, "writers"), table(spark, d, "orders"), []
    store.initial_load(o, X.ORDERS, root, buckets=4)

    def work(who):
        try:
            rows = o.where(f"o_orderkey % 3 = {who}").withColumns({"o_orderstatus": F.lit(str(who)), VERSION: F.lit(1).cast("long"), OP: F.lit("U")})
            store.apply_to_buckets(spark, rows, X.ORDERS, root)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(who,)) for who in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return store.read_target(spark, root, X.ORDERS)


@query(orders_sql() + "SELECT 'leased' AS part, * FROM orders_before UNION ALL SELECT 'now', * FROM orders_now")
def leased_reader(spark, d):
    """A reader with a lease goes on reading what it began with, though all of it is replaced and the
    store is vacuumed meanwhile."""
    root = scratch(spark, "lease")
    store.initial_load(X.orders_before(spark, d), X.ORDERS, root, buckets=4)
    with pointers.lease(spark, root) as held:
        old = store.read_target(spark, root, X.ORDERS, held)
        store.apply_to_buckets(spark, changes_of_orders(spark, d), X.ORDERS, root)
        store.vacuum(spark, root)
        kept = scratch(spark, "leased")
        old.write.parquet(kept)
    store.vacuum(spark, root)
    now = store.read_target(spark, root, X.ORDERS)
    return spark.read.parquet(kept).select(F.lit("leased").alias("part"), "*").unionByName(now.select(F.lit("now").alias("part"), "*"))


# runs ----------------------------------------------------------------------------------------------


@query(
    EVENTS
    + ", m AS (SELECT 1 + max(version) AS m FROM events_log)"
    + " UNION ALL ".join(" SELECT {n} AS first, * FROM ({net})".format(n=n, net=NET.format(keys="k", log=f"(SELECT * FROM events_log, m WHERE version >= {n} * m // 10)")) for n in range(10))
)
def net_from_runs(spark, d):
    """Ten windows of the events log that overlap, from runs: each log row is read once."""
    root, log = scratch(spark, "runs"), X.events_log(spark, d)
    m = log.agg(F.max("version") + 1).first()[0]
    for n in range(10):
        runs.add_segment(log, root, "events", ("k",), (n + 1) * m // 10 - 1)
    out = None
    for n in range(10):
        part = runs.net_from_runs(spark, root, "events", ("k",), n * m // 10 - 1 if n else None).select(F.lit(n).alias("first"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(EVENTS + "SELECT k, value, version AS _version, op AS _op FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, ctid DESC) AS n FROM batches) WHERE n = 1")
def consolidate_bucketed(spark, d):
    """Five change sets written in buckets of their key and made one without an exchange."""
    root, rows = scratch(spark, "bucketed"), batch_numbers(X.events_log(spark, d), 5).selectExpr("ctid", "k", "value", "version _version", "op _op")
    for c in range(1, 6):
        bucketed.write_bucketed(rows.where(F.col("ctid") == c).drop("ctid"), root, "events", c, ("k",), buckets=4)
    return bucketed.consolidate_bucketed(spark, root, "events", [1, 2, 3, 4, 5], rows.drop("ctid").limit(0), ("k",))


# flows ---------------------------------------------------------------------------------------------


@query(
    orders_sql()
    + """, c AS (SELECT *, o_orderkey % 2 AS shard FROM changes)
SELECT o_orderkey, o_totalprice, _op, NULL AS step, NULL AS expected_rows, NULL AS insert_count FROM c
UNION ALL SELECT NULL, NULL, NULL, step, NULL, NULL FROM (VALUES ('1 started'), ('2 waiting'), ('3 reverted'), ('4 waiting'), ('5 failed'), ('6 merged'), ('7 waiting')) AS s(step)
UNION ALL SELECT NULL, NULL, NULL, 'manifest', count(*), count(*) FILTER (_op <> 'D') FROM c"""
)
def shard_coordinator(spark, d):
    """Two shards' common batch: one lags, then their columns disagree and both capture again, then the
    merge fails on its way and is carried on."""
    from tidemark.plans import pipeline as P

    places = [("one", scratch(spark, "one")), ("two", scratch(spark, "two"))]
    root, spec = scratch(spark, "merged"), X.ORDERS
    log, now, steps = X.orders_log(spark, d), X.orders_now(spark, d), []
    for _, place in places:
        P.start_feed(spark, place, 0)

    def shard(n, base):
        mine = lambda df: df.where(f"o_orderkey % 2 = {n}")
        catalog = spark.createDataFrame([("orders", True, 0)], "table_name string, tracked boolean, min_valid_version long")
        plan, _, _ = P.publish_next(spark, {"orders": (mine(log), mine(base))}, [spec], places[n][1], 10**12, catalog, sharded=True)
        return plan

    def step(work=None):
        try:
            steps.append(P.coordinate(spark, [spec], places, root))
        except OSError:
            steps.append("failed")

    step()
    shard(0, now)
    step()
    shard(1, now.withColumn("o_custkey", F.col("o_custkey").cast("string")))
    step()
    shard(0, now)
    step()
    shard(1, now)
    real = P._merge_manifests

    def broken(*_):
        raise OSError("the shard is gone")

    P._merge_manifests = broken
    try:
        step()
    finally:
        P._merge_manifests = real
    step()
    step()
    done = store.read_change_set(spark, root, "orders", 1).select("o_orderkey", "o_totalprice", OP)
    told = spark.createDataFrame([(f"{n} {s}",) for n, s in enumerate(steps, 1)], "step string")
    manifest = spark.read.parquet(f"{root}/manifest/ctid=1").select(F.lit("manifest").alias("step"), "expected_rows", "insert_count")
    return done.unionByName(told, allowMissingColumns=True).unionByName(manifest, allowMissingColumns=True)


@query(
    orders_sql()
    + """, first AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders_log WHERE version <= 5000000)
SELECT 'now' AS part, o_orderkey, o_totalprice, NULL AS ctid, NULL AS start, NULL AS stop, NULL AS plan FROM orders_now
UNION ALL SELECT 'plan', NULL, NULL, 1, 0, 5000000, 'new' UNION ALL SELECT 'plan', NULL, NULL, 2, 5000000, 10000000, 'new' UNION ALL SELECT 'plan', NULL, NULL, 3, 10000000, 11000000, 'new'"""
)
def planned_batches(spark, d):
    """Batches planned from the ledger and cut to five million versions; a table that is being loaded is
    left out of the first one and captured from its own version in the next."""
    from tidemark.plans import pipeline as P

    relay, root, spec = scratch(spark, "relay"), scratch(spark, "slave"), X.ORDERS
    P.start_feed(spark, relay, 0)
    catalog = spark.createDataFrame([("Orders", True, 0)], "table_name string, tracked boolean, min_valid_version long")
    source = {"orders": (X.orders_log(spark, d), X.orders_now(spark, d))}
    P.begin_init(spark, relay, "orders", 0)
    store.initial_load(X.orders_before(spark, d), spec, root)
    plans = []
    for n in range(3):
        plan, _, failed = P.publish_next(spark, source, [spec], relay, 11_000_000, catalog, most=5_000_000)
        plans.append(("plan", plan["ctid"], plan["sync_start_version"], plan["sync_stop_version"], plan["plan"]))
        if n == 0:
            P.end_init(spark, relay, "orders")
    P.apply_batch(spark, [spec], relay, root, [1, 2, 3])
    now = store.read_target(spark, root, spec).select(F.lit("now").alias("part"), "o_orderkey", "o_totalprice")
    return now.unionByName(spark.createDataFrame(plans, "part string, ctid long, start long, stop long, plan string"), allowMissingColumns=True)


@query(
    orders_sql(0, 5_000_000)
    + """, one AS (SELECT count(*) FILTER (_op <> 'D') AS n FROM changes)
SELECT 'dbo' AS schema_name, 'orders' AS table_name, 1 AS ctid, n AS expected, n AS inserted, 0 AS percent, false AS error FROM one
UNION ALL SELECT 'dbo', 'orders', 2, n, n, 0, false FROM (SELECT count(*) AS n FROM orders_now WHERE o_orderkey IN (SELECT o_orderkey FROM orders_log WHERE version > 5000000))"""
)
def audited_batches(spark, d):
    """Expected against applied rows, kept by the flow after every batch; the second batch fails after it
    came into force, and its counts survive."""
    from tidemark.plans import pipeline as P

    relay, root = _published(spark, d, [X.ORDERS]), scratch(spark, "slave")
    store.initial_load(X.orders_before(spark, d), X.ORDERS, root)
    P.apply_batch(spark, [X.ORDERS], relay, root, [1])
    real = P.audit

    def broken(*_):
        raise OSError("stopped before the bit was set")

    P.audit = broken
    try:
        P.apply_batch(spark, [X.ORDERS], relay, root, [2])
    except OSError:
        pass
    finally:
        P.audit = real
    P.apply_batch(spark, [X.ORDERS], relay, root, [2])
    return P.read_audit(spark, root).withColumn("schema_name", F.coalesce("schema_name", F.lit("dbo")))


@query(
    orders_sql()
    + """, a AS (SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AS live FROM orders_before)
SELECT 'refresh' AS what, batch, name, NULL AS n FROM (VALUES (2, 'vwOrders')) AS r(batch, name)
UNION ALL SELECT 'rows', NULL, CASE WHEN live THEN 'orders' ELSE 'ordersarchive' END, count(*) FROM a GROUP BY live"""
)
def archive_views(spark, d):
    """A column is added to a table in one batch and to its archive in the next: the view over both is
    refreshed when both have it."""
    from tidemark.plans import pipeline as P

    relay, root, called = scratch(spark, "relay"), scratch(spark, "slave"), []
    specs = [TableSpec("TBLOrders", ("o_orderkey",)), TableSpec("TBLOrdersArchive", ("o_orderkey",))]
    before, cut = X.orders_before(spark, d), "o_orderdate < timestamp '1997-01-01'"
    store.initial_load(before.where(f"not ({cut})"), specs[0], root)
    store.initial_load(before.where(cut), specs[1], root)
    views = spark.createDataFrame([("vwOrders",), ("vwOther",)], "view_name string")
    for ctid, name in ((1, "TBLOrders"), (2, "TBLOrdersArchive")):
        change = [(1, "dbo", name, "Add", "o_extra", None, "int", None, None, None)]
        kinds = "event_id int, schema_name string, table_name string, event_type string, column_name string, new_column_name string, data_type string, length int, precision int, scale int"
        spark.createDataFrame(change, kinds).coalesce(1).write.parquet(f"{relay}/schema_changes/ctid={ctid}")
        P.apply_batch(spark, specs, relay, root, [ctid], refresh=lambda names, c=ctid: called.extend(("refresh", c, n) for n in names), views=views)
    out = spark.createDataFrame(called, "what string, batch int, name string").withColumn("n", F.lit(None).cast("long"))
    for s, name in zip(specs, ("orders", "ordersarchive"), strict=True):
        out = out.unionByName(store.read_target(spark, root, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("what"), F.lit(name).alias("name"), "n"), allowMissingColumns=True)
    return out


@query("SELECT * FROM (VALUES (1, true, 0), (2, false, 7)) AS t(ctid, trimmed, bits)")
def retire_records(spark, d):
    """Old batches leave the relay, and its ledger too; the last batch stays."""
    from tidemark.plans.pipeline import retire

    relay = _published(spark, d, [X.ORDERS])
    rows = store.read_ledger(spark, relay, "publisher").withColumn("sync_start_time", F.when(F.col("ctid") == 1, F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("sync_start_time")))
    store.record(spark, relay, "publisher", rows)
    cut = F.lit("2002-01-01").cast("timestamp")
    retire(spark, relay, cut, record_cut=cut)
    left = store.read_ledger(spark, relay, "publisher").select("ctid", "sync_bitwise")
    return spark.range(1, 3).join(left, F.col("id") == F.col("ctid"), "left").select(F.col("id").alias("ctid"), F.col("ctid").isNull().alias("trimmed"), F.coalesce("sync_bitwise", F.lit(0)).alias("bits"))


# streams -------------------------------------------------------------------------------------------


@query(
    EVENTS
    + """, b AS (SELECT *, CASE WHEN version * 2 < (SELECT max(version) FROM events_log) THEN 0 ELSE 1 END AS batch FROM events_log),
last AS (SELECT batch, k, arg_max(op, version) AS op FROM b GROUP BY ALL),
was AS (SELECT l.*, coalesce(p.op <> 'D', false) AS alive FROM last l LEFT JOIN last p ON l.batch = 1 AND p.batch = 0 AND l.k = p.k)
SELECT batch AS ctid, count(*) AS rows, count(*) FILTER (op <> 'D') AS inserted, count(*) FILTER (alive) AS deleted, 0 AS late FROM was GROUP BY batch"""
)
def stream_ledger(spark, d):
    """The events log in two micro-batches with deletes, the second one run again after it came into
    force: the ledger tells what each did to live rows."""
    from tidemark.streaming import stream_apply

    source, root, spec = scratch(spark, "stream"), scratch(spark, "target"), TableSpec("events", ("k",))
    rows = X.change_rows(spark, d)
    half = rows.agg(F.max(VERSION)).first()[0]
    # one file a batch
    for n, part in enumerate((f"{VERSION} * 2 < {half}", f"{VERSION} * 2 >= {half}")):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{source}/{n}")
    schema = rows.schema
    for n, checkpoint in ((0, "a"), (1, "b"), (1, "c")):
        read = spark.readStream.schema(schema).parquet(f"{source}/{n}")
        stream_apply(read, root, spec, f"{root}/checkpoint-{checkpoint}", first_batch=n).awaitTermination()
    return store.read_ledger(spark, root, "stream").select("ctid", "rows", "inserted", "deleted", "late")


@query(
    EVENTS
    + """, m AS (SELECT max(version) + 1 AS m FROM events_log), b AS (SELECT e.*, version * 10 // m AS batch, m FROM events_log e, m)
SELECT k, value, NULL AS late, NULL AS forgotten FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM b) WHERE n = 1 AND op <> 'D'
UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM b WHERE batch = 0), true"""
)
def stream_forget(spark, d):
    """Ten micro-batches with a watermark, then the first one once more: its rows are late, kept aside and
    counted, and of keys deleted long ago few are still remembered."""
    from tidemark.streaming import live, read_late, stream_apply

    source, root, spec = scratch(spark, "stream"), scratch(spark, "target"), TableSpec("events", ("k",))
    rows = X.change_rows(spark, d)
    m = rows.agg(F.max(VERSION) + 1).first()[0]
    for n in range(10):
        rows.where(f"{VERSION} * 10 div {m} = {n}").coalesce(1).write.parquet(f"{source}/{n}")
    for batch, n in enumerate([*range(10), 0]):
        read = spark.readStream.schema(rows.schema).parquet(f"{source}/{n}")
        stream_apply(read, root, spec, f"{root}/checkpoint-{batch}", delay=m // 5, purge=1, buckets=1, first_batch=batch).awaitTermination()
    target = store.read_target(spark, root, spec)
    old = target.where(F.col("_deleted") & (F.col(VERSION) <= m - m // 5 - 1)).count() * store.SHARE <= target.count()
    told = read_late(spark, root, spec).agg(F.count(F.lit(1)).alias("late")).withColumn("forgotten", F.lit(old))
    return live(target).withColumns({"late": F.lit(None).cast("long"), "forgotten": F.lit(None).cast("boolean")}).unionByName(told, allowMissingColumns=True)


# other databases -----------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN chr(CAST(97 + c_custkey % 26 AS INTEGER)) || c_name ELSE 'x' || c_name END AS name, c_nationkey, NULL AS even FROM customer
UNION ALL SELECT NULL, NULL, NULL, true"""
)
def jdbc_ranges(spark, d):
    """A table of an embedded database read over ranges of a skewed text key and a number: quantiles of
    sampled keys make partitions of about the same size."""
    name = "case when c_custkey % 10 = 0 then concat(char(97 + c_custkey % 26), c_name) else concat('x', c_name) end"
    rows = table(spark, d, "customer").selectExpr("cast(c_custkey as int) c_custkey", f"{name} name", "cast(c_nationkey as int) c_nationkey")
    at = jdbc.embedded(spark, rows, "customer", {"name": "varchar(40)"})
    got = jdbc.jdbc_read(spark, "derby", table="customer", key=("name", "c_nationkey"), partitions=8, **at)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    told = spark.createDataFrame([(len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8,)], "even boolean")
    kinds = {f.name.lower(): f.name for f in got.schema}
    return got.select(*[F.col(kinds[c]).alias(c) for c in ("c_custkey", "name", "c_nationkey")], F.lit(None).cast("boolean").alias("even")).unionByName(told, allowMissingColumns=True)
