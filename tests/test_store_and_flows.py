"""Targets under failed attempts, flows that stop and resume, and plans that must stay cheap."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pyspark
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import APPLY_SCHEMA, COMPLETE
from tidemark.functions import types as T
from tidemark.operators import apply as A
from tidemark.operators import changes as C
from tidemark.operators import manifest as N
from tidemark.operators import schema as S
from tidemark.operators import shards as H
from tidemark.plans import fixtures as X
from tidemark.plans import pipeline as P
from tidemark.sources import delimited, jdbc, paths, store
from tidemark.spec import OP, VERSION, TableSpec

CHANGES = f"k int, v string, {VERSION} long, {OP} string"
T1 = TableSpec("t", ("k",))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def loaded(spark, root, n=50, buckets=8):
    store.initial_load(spark.createDataFrame([(k, f"v{k}") for k in range(n)], "k int, v string"), T1, root, buckets=buckets)


def test_failed_attempts_leave_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    loaded(spark, root)
    before = rows(store.read_target(spark, root, T1))
    changes = spark.createDataFrame([(k, "new", 1, "U") for k in range(50)], CHANGES)

    def broken(*_):
        raise OSError("no pointer was written")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", broken)
        with pytest.raises(OSError, match="no pointer"):
            store.apply_group(spark, root, [(T1, changes)])
    assert rows(store.read_target(spark, root, T1)) == before
    one = spark.createDataFrame([(7, None, 2, "D"), (99, "x", 2, "I"), (7000, None, 2, "D")], CHANGES)
    did = store.apply_group(spark, root, [(T1, one)])[0]
    assert (did.inserted, did.deleted) == (1, 1) and len(did.buckets) <= 3
    assert rows(store.read_target(spark, root, T1)) == sorted([r for r in before if r[0] != 7] + [(99, "x")], key=repr)
    gone = store.vacuum(spark, root)
    assert len(gone) >= 2 and store.vacuum(spark, root) == []
    assert store.read_target(spark, root, T1).count() == 50


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path)
    loaded(spark, root, buckets=32)
    before = store.target(spark, root, "t")
    did = store.apply_to_buckets(spark, spark.createDataFrame([(3, "new", 1, "U")], CHANGES), T1, root)
    after = store.target(spark, root, "t")
    assert len(did.buckets) == 1 and {b for b in before.places if before.places[b] != after.places[b]} == set(did.buckets)


def test_reinitialize_and_append(spark, tmp_path):
    root = str(tmp_path)
    loaded(spark, root, 1000)
    store.initial_load(spark.createDataFrame([(1, "one", True)], "k long, v string, more boolean"), T1, root, "reinitialize")
    assert rows(store.read_target(spark, root, T1)) == [(1, "one")] and store.read_target(spark, root, T1).dtypes == [("k", "int"), ("v", "string")]
    store.initial_load(spark.createDataFrame([(2, "two")], "k int, v string"), T1, root, "append")
    store.apply_to_buckets(spark, spark.createDataFrame([(1, None, 1, "D")], CHANGES), T1, root)
    assert rows(store.read_target(spark, root, T1)) == [(2, "two")]
    store.apply_to_buckets(spark, spark.createDataFrame([(2, None, 1, "D")], CHANGES), T1, root)  # the last row goes
    assert rows(store.read_target(spark, root, T1)) == []
    with pytest.raises(ValueError):
        store.initial_load(spark.createDataFrame([(2, "two")], "k int, v string"), TableSpec("new", ("k",)), root, "append")


def test_layout_replaces_what_was_there(spark, tmp_path):
    path, df = str(tmp_path / "x"), spark.range(1000).selectExpr("cast(id as int) k")
    store.write_with_layout(df, path, T1, partitions=16)
    store.write_with_layout(df.limit(1), path, T1, partitions=16)
    assert spark.read.parquet(path).count() == 1
    assert [store.buckets_for(n) for n in (0, 1, store.ROWS, store.ROWS + 1, 100 * store.ROWS)] == [1, 1, 1, 2, 128]


def test_two_changes_of_a_key_are_rejected(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "b", 1, "U"), (1, "c", 2, "U"), (None, "d", 1, "I"), (None, "d", 1, "I")], CHANGES)
    with pytest.raises(Exception, match="more than one change of the key 1"):
        A.apply_merge(target, twice, T1).collect()
    assert len(rows(A.apply_merge(target, twice.where("k is null"), T1))) == 3


def test_shards_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([("x", None, "a", 1, "U"), ("y", None, "b", 1, "U"), ("x", 1, "c", 1, "D"), ("y", 1, "d", 1, "U")], f"shard string, {CHANGES}")
    assert rows(H.merge_shard_rows(df, ("k",), ["x", "y"]).select("k", "v")) == [(1, "d"), (None, "a"), (None, "b")]


def test_tables_are_matched_by_schema_without_case(spark):
    tables = spark.createDataFrame([("dbo", "Orders", ["k"]), ("x", "orders", ["k"])], "schema_name string, table_name string, pk array<string>")
    changes = spark.createDataFrame([("DBO", "ORDERS", "I"), (None, "orders", "D"), ("X", "Orders", "U")], f"schema_name string, table_name string, {OP} string")
    assert rows(N.build_manifest(changes, tables).select("schema_name", "expected_rows", "insert_count")) == [("dbo", 2, 1), ("x", 1, 1)]
    assert rows(N.row_counts(changes, tables)) == [("dbo", "Orders", 2), ("x", "orders", 1)]
    m = spark.createDataFrame([("a", 1), ("A", 2)], "table_name string, insert_count long")
    got = N.audit_counts(m, spark.createDataFrame([("a", 30_000_000)], "table_name string, inserted long")).first()
    assert (got.expected, got.percent) == (3, -999999900)
    big = N.audit_counts(spark.createDataFrame([("a", 1)], m.schema), spark.createDataFrame([("a", 3 * 10**9)], "table_name string, inserted long")).first()
    assert big.percent == -299999999900


def test_strict_files(spark, tmp_path):
    schema = "k int, v string"
    df = spark.createDataFrame([(1, "a"), (2, None)], schema)
    delimited.write_delimited(df, str(tmp_path / "s"), delimited.STRICT)
    assert b"\r\n" in b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/s/*.txt"))
    assert rows(delimited.read_strict(spark, str(tmp_path / "s"), df.schema)) == [(1, "a"), (2, None)]
    (tmp_path / "lf").write_bytes(b"1|a\n2|\n")
    assert rows(delimited.read_strict(spark, str(tmp_path / "lf"), df.schema, record="\n")) == [(1, "a"), (2, None)]
    for bad in (b"x|a\r\n", b"1\r\n", b"1|a|b\r\n"):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match="malformed record"):
            delimited.read_strict(spark, str(tmp_path / "bad"), df.schema).collect()


# A mapping file, its types in order, and what each becomes.
SOURCE = ["binary", "bit", "datetime", "datetime2", "float", "hierarchyid", "image", "money", "ntext", "real", "smalldatetime", "smallmoney", "sql_variant", "text", "tinyint", "uniqueidentifier", "varbinary", "xml"]
DEST = ["char", "byteint", "timestamp", "timestamp", "double precision", "varchar(100)", "varchar(100)", "decimal(20,4)", "nvarchar(500)", "double precision", "timestamp", "decimal(20,4)", "nvarchar(500)", "varchar(500)", "smallint", "varchar(64)", "varchar", "nvarchar(500)"]


def test_type_mapping(spark, tmp_path):
    path = tmp_path / "mappings"
    path.write_text("MSSQL\tNetezza\n" + "".join(f"{a}\t{b}\n" for a, b in zip(SOURCE, DEST, strict=True)))
    columns = spark.createDataFrame([(t,) for t in [*SOURCE, "int"]], "data_type string")
    mapping = T.read_mapping(spark, str(path))
    got = {r.data_type: r.mapped for r in T.map_types(columns, mapping, "MSSQL", "netezza").collect()}
    assert got == {**dict(zip(SOURCE, DEST, strict=True)), "int": "int"}
    with pytest.raises(ValueError, match="no type mapping"):
        T.map_types(columns, mapping, "MySQL", "MSSQL")


@pytest.mark.parametrize(
    ("dialect", "row", "expected"),
    [
        ("netezza", ("varchar", "varchar", 50, None, None, None), "varchar(50)"),
        ("netezza", ("varchar", "varchar", -1, None, None, None), "varchar(16000)"),
        ("netezza", ("varchar", "varchar", 50, None, None, 9), "varchar(9)"),
        ("netezza", ("text", "varchar(500)", -1, None, None, 9), "varchar(9)"),
        ("netezza", ("text", "varchar(500)", -1, None, None, None), "varchar(500)"),
        ("netezza", ("money", "decimal(20,4)", None, 19, 4, None), "decimal(20,4)"),
        ("netezza", ("decimal", "decimal", None, 12, 3, None), "decimal(12,3)"),
        ("netezza", ("varchar", "varchar", None, None, None, None), "varchar"),
        ("vertica", ("money", "money", None, 19, 4, None), "money(19, 4)"),
        ("vertica", ("varchar", "varchar", 500, None, None, 7), "varchar(7)"),
        ("vertica", ("text", "varchar(500)", -1, None, None, 7), "varchar(7)"),
        ("vertica", ("varchar", "varchar", None, None, None, None), "varchar"),
        ("vertica", ("varchar", "varchar", -1, None, None, None), "varchar(65000)"),
        ("vertica", ("numeric", "numeric", None, 9, None, None), "numeric"),
        ("mysql", ("nvarchar", "nvarchar", -1, None, None, None), "longtext"),
        ("mysql", ("char", "char", 8, None, None, None), "char(8)"),
        ("mssql", ("varchar", "varchar", 8000, None, None, None), "varchar(MAX)"),
        ("mssql", ("text", "text", None, None, None, None), "text(MAX)"),
        ("mssql", ("decimal", "decimal", None, None, None, None), "decimal(18)"),
        ("mssql", ("decimal", "decimal", None, 10, 2, None), "decimal(10,2)"),
        ("mssql", ("int", "int", None, 10, 0, None), "int"),
    ],
)
def test_target_types(spark, dialect, row, expected):
    df = spark.createDataFrame([row], "data_type string, mapped string, length int, precision int, scale int, modifier int")
    assert T.target_type(df, dialect).first().target == expected


def test_added_column_without_a_type_is_an_error(spark):
    xml = "<EVENT_INSTANCE><EventType>ALTER_TABLE</EventType><SchemaName>dbo</SchemaName><ObjectName>t</ObjectName><AlterTableActionList><Create><Columns><Name>c</Name></Columns></Create></AlterTableActionList></EVENT_INSTANCE>"
    events = spark.createDataFrame([(1, dt.datetime(2020, 1, 2), xml)], "id int, ts timestamp, xml string")
    listing = "schema_name string, table_name string, column_name string, data_type string, length int, precision int, scale int"
    since = dt.datetime(2020, 1, 1)
    with pytest.raises(Exception, match="no type for the added column"):
        S.publish_schema_changes(events, spark.createDataFrame([("dbo", "t", "c", None, None, None, None)], listing), [TableSpec("t")], since).collect()
    assert S.publish_schema_changes(events, spark.createDataFrame([], listing), [TableSpec("t")], since).count() == 0


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_capture_plans(spark):
    log, base = X.orders_log(spark, SF), X.orders_now(spark, SF)
    net = plan(C.net_changes(log, ("o_orderkey",)))
    assert "Sort" not in net and "HashAggregate" in net
    assert "SortAggregate" not in plan(C.capture_by_time(log.withColumn("ts", F.expr("timestamp_seconds(version)")), base, X.ORDERS, dt.datetime(1970, 1, 1)))
    few = plan(C.capture_changes(log, base, X.ORDERS, 0, 10**12))
    assert few.count("LeftSemi") and "BroadcastHashJoin" in few


def test_flow_stops_and_resumes(spark, tmp_path):
    relay, root, spec = str(tmp_path / "relay"), str(tmp_path / "root"), TableSpec("T", ("k",), history=True)
    log = spark.createDataFrame([(1, 5, "U"), (2, 6, "I")], "k int, version long, op string")
    base = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    loaded(spark, root, 2)
    P.publish(spark, {"T": (log, base)}, [spec], relay, 1, 0, 10)
    P.publish(spark, {"T": (log.limit(0), base)}, [spec], relay, 1, 0, 10)  # captured already: nothing is captured again
    assert store.read_change_set(spark, relay, "t", 1).count() == 2
    assert store.read_ledger(spark, relay, "publisher").first().sync_bitwise == 7
    counts, failed = P.apply_batch(spark, [spec], relay, root, [1], until=APPLY_SCHEMA)
    assert counts.count() == 0 and store.read_ledger(spark, root, "subscriber").first().sync_bitwise == 8
    for _ in range(2):
        counts, failed = P.apply_batch(spark, [spec], relay, root, [1])
        assert rows(counts) == [("T", 2, 1)] and not failed
    done = store.read_ledger(spark, root, "subscriber").first()
    assert done.sync_bitwise == COMPLETE and done.sync_stop_time is not None
    assert rows(store.read_target(spark, root, spec)) == [(0, "v0"), (1, "b"), (2, "c")]
    assert {r.step for r in P.read_steps(spark, root, "subscriber").collect()} == {"ApplySchemaChanges", "DownloadChanges", "ApplyChanges", "SyncHistoryTables"}
    lost = TableSpec("lost", ("k",), stop_on_error=False)
    _, failed = P.publish(spark, {"T": (log, base), "lost": (log, base.drop("k"))}, [spec, lost], relay, 2, 10, 20)
    assert [name for name, _ in failed] == ["lost"] and spark.read.parquet(f"{relay}/errors").count() == 1


def test_tables_over_jdbc(spark, tmp_path):
    if not glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "derby-*.jar")):
        pytest.skip("no JDBC driver here")
    at = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(100).selectExpr("cast(id as int) k", "concat('v', id) v")
    jdbc.jdbc_writer(df.coalesce(1), "mssql", table="t", types={"v": "varchar(20)"}, **at).mode("overwrite").save()
    got = jdbc.jdbc_read(spark, "mssql", table="t", key="k", bounds=(0, 100), partitions=4, **at)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("k")).first()[0] == 4950 and got.count() == 100


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        paths.shared(Session())
