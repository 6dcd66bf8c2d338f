"""Small cases with known results for the replication operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import has_bit, integer_suffix
from tidemark.functions.text import escape_text
from tidemark.operators import apply as A
from tidemark.operators import changes as C
from tidemark.operators import ledger as B
from tidemark.operators import manifest as N
from tidemark.operators import retention as R
from tidemark.operators import schema as S
from tidemark.operators import shards as H
from tidemark.sources import delimited, jdbc, store
from tidemark.spec import OP, VERSION, TableSpec

LEDGER = "feed int, ctid long, sync_start_version long, sync_stop_version long, sync_start_time timestamp, sync_stop_time timestamp, sync_bitwise int"


def test_spec_checks_names_and_combines():
    with pytest.raises(ValueError):
        TableSpec("drop table;--")
    with pytest.raises(ValueError):
        TableSpec("t", shorten={"a": 0})
    both = TableSpec("t", ("k",), ("a", "B"), shorten={"a": 9}).both(TableSpec("t", columns=("b", "c"), shorten={"A": 5}))
    assert both.columns == ("B",) and both.shorten == {"a": 5} and both.pk == ("k",)
    assert TableSpec("t", columns=("a",)).both(TableSpec("t")).columns == ("a",)


@pytest.mark.parametrize(
    ("bits", "expected"),
    [(7, (101, 2000, 2500, "new")), (0, (100, 1000, 2500, "retry")), (3, (100, 1000, 2000, "resume"))],
)
def test_plan_batch(spark, bits, expected):
    t = dt.datetime(2012, 1, 1, 12)
    ledger = spark.createDataFrame([(1, 100, 1000, 2000, t, None, bits)], LEDGER)
    r = B.plan_batch(ledger, spark.createDataFrame([(1, 2500), (2, 10)], "feed int, current_version long")).orderBy("feed").collect()
    assert (r[0].ctid, r[0].sync_start_version, r[0].sync_stop_version, r[0].plan) == expected
    assert r[1].error and r[1].plan is None
    assert B.plan_batch(ledger, spark.createDataFrame([(1, 2500)], "feed int, current_version long"), sharded=True).first().plan == ("wait" if bits == 7 else expected[3])


@pytest.mark.parametrize(
    ("stop", "most", "window", "clock", "expected"),
    [
        (1000, 0, (None, None), "12:00:00", 1000),
        (1500, 500, (None, None), "12:00:00", 1000),
        (1500, 500, ("01:00:00", "03:00:00"), "12:00:00", 1000),
        (1500, 500, ("01:00:00", "03:00:00"), "02:00:00", 1500),
        (1500, 500, ("23:45:00", "01:30:00"), "12:00:00", 1000),
        (1500, 500, ("23:45:00", "01:30:00"), "23:55:00", 1500),
        (1500, 500, ("23:45:00", "01:30:00"), "00:30:00", 1500),
    ],
)
def test_resize(spark, stop, most, window, clock, expected):
    df = spark.createDataFrame([(500, stop)], "sync_start_version long, sync_stop_version long")
    assert B.resize_batches(df, most, F.lit(f"2000-01-01 {clock}").cast("timestamp"), *window).first().sync_stop_version == expected


def test_full_run_time(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    hours = F.array(F.lit("03:00:00"))
    row = spark.range(1).select(
        B.is_full_run_time(at("2024-05-02 03:01:00"), at("2024-05-02 03:02:00"), hours).alias("a"), B.is_full_run_time(at("2024-05-01 03:02:00"), at("2024-05-02 03:01:00"), hours).alias("b")
    ).first()
    assert (row.a, row.b) == (False, True)
    with pytest.raises(Exception, match="future"):
        spark.range(1).select(B.is_full_run_time(at("2024-05-03 00:00:00"), at("2024-05-02 00:00:00"), hours)).collect()


def ddl(kind, body, table="test1"):
    return f"<EVENT_INSTANCE><EventType>{kind}</EventType><SchemaName>dbo</SchemaName><ObjectName>{table}</ObjectName><ObjectType>TABLE</ObjectType>{body}</EVENT_INSTANCE>"


def columns(kind, *names):
    return f"<AlterTableActionList><{kind}><Columns>{''.join(f'<Name>{n}</Name>' for n in names)}</Columns></{kind}></AlterTableActionList>"


def rename(obj, kind, target, new):
    return f"<EVENT_INSTANCE><EventType>RENAME</EventType><SchemaName>dbo</SchemaName><ObjectName>{obj}</ObjectName><ObjectType>{kind}</ObjectType><TargetObjectName>{target}</TargetObjectName><NewObjectName>{new}</NewObjectName></EVENT_INSTANCE>"


@pytest.mark.parametrize(
    ("xml", "expected"),
    [
        (ddl("ALTER_TABLE", columns("Create", "column1")), [("Add", "column1", None)]),
        (ddl("ALTER_TABLE", columns("Create", "column1", "column2")), [("Add", "column1", None), ("Add", "column2", None)]),
        (ddl("ALTER_TABLE", columns("Create", "column3"), "test2"), []),
        (ddl("ALTER_TABLE", columns("Create", "COLUMN2"), "TEST2"), [("Add", "COLUMN2", None)]),
        (ddl("ALTER_TABLE", columns("Alter", "column1")), [("Modify", "column1", None)]),
        (ddl("ALTER_TABLE", columns("Drop", "column1")), [("Drop", "column1", None)]),
        (ddl("ALTER_TABLE", "<AlterTableActionList><Create><Constraints><Name>df</Name></Constraints></Create></AlterTableActionList>"), []),
        (ddl("ALTER_TABLE", ""), []),
        (ddl("CREATE_TABLE", ""), []),
        (ddl("ALTER_TABLE", columns("Create", "x"), "other"), []),
        (rename("column1", "COLUMN", "test1", "col_1"), [("Rename", "column1", "col_1")]),
        (rename("column9", "COLUMN", "test2", "x"), []),
        (rename("test1", "TABLE", "", "test9"), []),
    ],
)
def test_ddl(spark, xml, expected):
    specs = [TableSpec("test1"), TableSpec("test2", columns=("column1", "column2"))]
    got = S.parse_ddl_events(spark.createDataFrame([(100, dt.datetime(2012, 1, 1), xml)], "id int, ts timestamp, xml string"), specs)
    assert sorted((r.event_type, r.column_name, r.new_column_name) for r in got.collect()) == sorted(expected)


def test_evolve_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    steps = [{"event_type": "Add", "column_name": "n", "data_type": "decimal", "precision": 9, "scale": 2}, {"event_type": "Rename", "column_name": "v", "new_column_name": "w"}, {"event_type": "Drop", "column_name": "gone"}]
    assert S.evolve(df, steps + steps).dtypes == [("k", "int"), ("w", "string"), ("n", "decimal(9,2)")]
    with pytest.raises(ValueError):
        S.evolve(df, [{"event_type": "Explode", "column_name": "k"}])


def test_net_changes(spark):
    log = spark.createDataFrame([(1, 1, "I"), (1, 2, "U"), (2, 3, "U"), (3, 4, "I"), (3, 5, "D"), (4, 6, "D"), (4, 7, "I"), (5, 1, "I"), (5, 9, "U")], "k int, version long, op string")
    got = {r.k: (r[VERSION], r[OP], r.creation_version) for r in C.net_changes(log, ("k",), 1).collect()}
    assert got == {1: (2, "U", None), 2: (3, "U", None), 3: (5, "D", 4), 4: (7, "I", 7), 5: (9, "U", None)}


def test_capture_window(spark):
    log = spark.createDataFrame([(1, 5, "U"), (2, 15, "U"), (3, 6, "I"), (3, 20, "U"), (4, 7, "D"), (5, 8, "U")], "k int, version long, op string")
    base = spark.createDataFrame([(1, "aaaa", "x"), (2, "bbbb", "x"), (3, "cccc", "x")], "k int, v string, unwanted string")
    got = C.capture_changes(log, base, TableSpec("t", ("k",), ("v",), shorten={"v": 2}), 0, 10)
    assert sorted(tuple(r) for r in got.select("k", "v", OP).collect()) == [(1, "aa", "U"), (3, "cc", "I"), (4, None, "D")]
    assert got.columns == ["k", "v", VERSION, OP]


def test_null_keys_are_never_duplicates_nor_matched(spark):
    rows = spark.createDataFrame([(None, 1, "U", "a"), (None, 1, "U", "b"), (1, 1, "U", "c"), (1, 2, "D", "d")], f"k int, {VERSION} long, {OP} string, v string")
    assert C.dedupe_changes(rows, ("k",)).count() == 3
    target = spark.createDataFrame([(None, "old"), (1, "old")], "k int, v string")
    merged = A.apply_merge(target, C.dedupe_changes(rows, ("k",)), TableSpec("t", ("k",)))
    assert sorted(((r.k, r.v) for r in merged.collect()), key=repr) == [(None, "a"), (None, "b"), (None, "old")]


def test_apply_semantics_differ(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, v string, keep int")
    changes = spark.createDataFrame([(1, "A", 5, "U"), (2, None, 6, "D"), (4, "D", 7, "I"), (9, None, 8, "D")], f"k int, v string, {VERSION} long, {OP} string")
    spec = TableSpec("t", ("k",))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(A.apply_merge(target, changes, spec)) == [(1, "A", 10), (3, "c", 30), (4, "D", None)]
    assert rows(A.apply_delete_insert(target, changes, spec)) == [(1, "A", None), (3, "c", 30), (4, "D", None)]
    twice = changes.unionByName(changes.where("k = 4").withColumn(VERSION, F.lit(9).cast("long")).withColumn("v", F.lit("E")))
    assert [r for r in rows(A.apply_delete_insert(target, twice, spec)) if r[0] == 4] == [(4, "D", None), (4, "E", None)]
    assert [r for r in rows(A.apply_replace(target, twice, spec)) if r[0] == 4] == [(4, "E", None)]
    assert tuple(A.apply_counts(target, changes, spec).first()) == (2, 2)


def test_all_key_tables_stay(spark):
    target = spark.createDataFrame([("a",), ("B",)], "k string")
    changes = spark.createDataFrame([("A", 1, "U"), ("b", 2, "D"), ("c", 3, "I")], f"k string, {VERSION} long, {OP} string")
    assert sorted(r.k for r in A.apply_merge(target, changes, TableSpec("t", ("k",), ignore_case=True)).collect()) == ["a", "c"]


def test_archives_pair_in_any_order(spark):
    for names in (["tblNameArchive", "tblName", "aloneArchive"], ["tblName", "aloneArchive", "tblNameArchive"]):
        got = A.pair_archives(spark.createDataFrame([(n,) for n in names], "table_name string"))
        assert sorted(((r.table_name, r.archive_name) for r in got.collect()), key=repr) == [("aloneArchive", None), ("tblName", "tblNameArchive")]


def test_shards(spark):
    a = spark.createDataFrame([(1, "a", 1, "D"), (2, "a", 1, "U")], f"k int, v string, {VERSION} long, {OP} string")
    b = spark.createDataFrame([(1, "b", 9, "U"), (2, "b", 9, "I"), (3, "b", 9, "D")], f"k int, v string, {VERSION} long, {OP} string")
    got = H.merge_shards([("x", a), ("y", b)], ("k",), ["x", "y"])
    assert sorted((r.k, r.v, r[OP]) for r in got.collect()) == [(1, "b", "U"), (2, "a", "U"), (3, "b", "D")]
    cols = "shard string, table_name string, column_name string, is_pk boolean, data_type string"
    same = [("1", "t", "a", True, "int"), ("1", "t", "b", False, "int"), ("2", "t", "B", False, "INT"), ("2", "t", "a", True, "int")]
    assert H.schemas_out_of_sync(spark.createDataFrame(same, cols)).count() == 0
    assert H.schemas_out_of_sync(spark.createDataFrame([*same[:3], ("2", "t", "a", False, "int")], cols)).count() == 1


def test_retention_names(spark):
    names = ["tblCTtblTest_3", "tblCTtblTest_4", "tblCTtblTest_5", "tblCTtblTest_6", "tblCTTableInfo_3", "tblCTVersion"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = R.drop_expired(df, spark.createDataFrame([(3,), (4,), (5,)], "ctid long"))
    assert sorted(r.name for r in got.collect()) == ["tblCTTableInfo_3", "tblCTtblTest_3", "tblCTtblTest_4", "tblCTtblTest_5"]
    assert df.select(integer_suffix(F.col("name")).alias("n")).where("n is null").count() == 1
    with pytest.raises(ValueError):
        R.check_retention(10, 5)


def test_audit(spark):
    manifest = spark.createDataFrame([("a", 10), ("b", 0), ("c", 0), ("d", 3)], "table_name string, insert_count long")
    applied = spark.createDataFrame([("a", 8), ("c", 2), ("d", 4)], "table_name string, inserted long")
    got = {r.table_name: (r.percent, r.error) for r in N.audit_counts(manifest, applied).collect()}
    assert got == {"a": (20, False), "b": (0, False), "c": (None, True), "d": (-33, False)}


def test_escape_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\\b "c"|d\r\ne\nNULL'), (2, None)], "k int, v string")
    assert [r.v for r in escape_text(df, "netezza").orderBy("k").collect()] == ['a\\\\b \\"c\\",d e \\NULL', "\\NULL".replace("\\", "")]
    assert escape_text(df, "vertica").where("v is null").count() == 1
    odd = spark.createDataFrame([(1, "x\ny"), (2, ""), (3, None)], "k int, v string")
    delimited.write_delimited(odd, str(tmp_path / "m"), delimited.MYSQL)
    assert sorted(tuple(r) for r in delimited.read_delimited(spark, str(tmp_path / "m"), odd.schema).where("v is not null").collect()) == [(1, "x\ny"), (2, "")]
    (tmp_path / "bad.txt").write_text("1|a\nx|b\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast|cannot be cast|number"):
        delimited.read_strict(spark, str(tmp_path / "bad.txt"), odd.schema).collect()
    (tmp_path / "tol.txt").write_bytes(b"1|abc\x00def\r\n2\n")
    assert sorted(tuple(r) for r in delimited.read_tolerant(spark, str(tmp_path / "tol.txt"), odd.schema, {"v": 4}).collect()) == [(1, "abcd"), (2, None)]


def test_store(spark, tmp_path):
    root, spec = str(tmp_path), TableSpec("T", ("k",))
    base = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k int, v string")
    store.initial_load(base, spec, root)
    changes = spark.createDataFrame([(k, None, 1, "D") for k in range(49)] + [(100, "new", 1, "I")], f"k int, v string, {VERSION} long, {OP} string")
    store.write_change_set(changes, root, "t", 1)
    for _ in range(2):  # a repeated apply changes nothing
        store.apply_to_buckets(spark, store.read_change_set(spark, root, "T", 1), spec, root)
        assert sorted(tuple(r) for r in store.read_target(spark, root, spec).collect()) == [(49, "v49"), (100, "new")]
    assert store.read_change_set(spark, root, "t", 2) is None
    assert store.copy_change_sets(spark, root, root, [("t", 1)], 1) == []
    with pytest.raises(ValueError):
        store.write_with_layout(base, root + "/x", TableSpec("t"))


def test_late_and_repeated_changes_in_a_stream(spark, tmp_path):
    from tidemark.streaming import live, stream_apply

    spec, root = TableSpec("t", ("k",), history=True), str(tmp_path / "root")
    schema = f"k int, v string, {VERSION} long, {OP} string"
    files = [[(1, "a", 5, "I"), (2, "b", 6, "I")], [(1, "late", 3, "U"), (2, None, 8, "D"), (3, "c", 7, "I")], [(2, "late", 7, "U"), (3, "c2", 9, "U"), (1, "a", 5, "I")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_apply(stream, root, spec, str(tmp_path / "cp")).awaitTermination()
    got = live(store.read_target(spark, root, spec))
    assert sorted(tuple(r) for r in got.select("k", "v").collect()) == [(1, "a"), (3, "c2")]
    assert store.read_history(spark, root, "t").select("CTHistID").distinct().count() == 3
    assert sorted((r.ctid, r.sync_start_version, r.sync_stop_version, r.rows) for r in store.read_ledger(spark, root, "stream").collect()) == [(0, 5, 6, 2), (1, 3, 8, 3), (2, 5, 9, 3)]


def test_bits_and_routes(spark):
    assert spark.range(1).select(has_bit(F.lit(6), 4), has_bit(F.lit(6), 1)).first()[:] == (True, False)
    jdbc.check_route("MSSQL", "Netezza")
    with pytest.raises(ValueError):
        jdbc.check_route("netezza", "mssql")
