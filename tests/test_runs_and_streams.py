"""Kept runs of net changes, captures that read once, streams whose ledgers count and whose deleted keys
are forgotten, coordinated shards, and ranges of foreign tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import changes as C
from tidemark.operators import consolidate as U
from tidemark.operators import schema as S
from tidemark.plans import fixtures as X
from tidemark.plans import pipeline as P
from tidemark.sources import bucketed, jdbc, pointers, runs, store
from tidemark.spec import OP, VERSION, TableSpec
from tidemark.streaming import live, read_late, stream_apply

CHANGES = f"k int, v string, {VERSION} long, {OP} string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_runs_of_any_window(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.randrange(12), rng.choice([None, "x", "y"]), v, rng.choice("IUD")) for v in range(400)]
    log = spark.createDataFrame(data, "a int, b string, version long, op string").cache()
    ends = [30, 60, 61, 90, 200, 250, 330, 399]
    for n, high in enumerate(ends, 1):
        assert runs.add_segment(log, str(tmp_path), "T", ("a", "b"), high) == n == runs.add_segment(log, str(tmp_path), "t", ("a", "b"), high)
    segments = runs._segments(spark, str(tmp_path), "t")
    assert [len(s["runs"]) for s in segments] == [1, 2, 1, 3, 1, 2, 1, 4]
    assert len(runs.runs_of_window(segments, 0)) == 1 and len(runs.runs_of_window(segments, 1)) == 3
    for start in [None, 30, 61, 250, 100, 399]:
        want = C.net_changes(log, ("a", "b"), start)
        assert rows(runs.net_from_runs(spark, str(tmp_path), "t", ("a", "b"), start, log)) == rows(want), start
    with pytest.raises(ValueError, match="inside a segment"):
        runs.net_from_runs(spark, str(tmp_path), "t", ("a", "b"), 100)


def test_overlapping_windows_read_the_log_once(spark, tmp_path):
    """Ten windows from runs have no scan of the log in their plans."""
    path = str(tmp_path / "log")
    X.orders_log(spark, SF).write.parquet(path)
    log = spark.read.parquet(path)
    for n in range(10):
        runs.add_segment(log, str(tmp_path), "orders", ("o_orderkey",), 1000 + 1500 * n if n < 9 else 10**12)
    for n in range(9):
        got = runs.net_from_runs(spark, str(tmp_path), "orders", ("o_orderkey",), 1000 + 1500 * n)
        assert not any("/log/" in f for f in got.inputFiles()) and len(runs.runs_of_window(runs._segments(spark, str(tmp_path), "orders"), n + 1)) <= 4
    assert rows(got) == rows(C.net_changes(log, ("o_orderkey",), 1000 + 1500 * 8))


def test_a_capture_reads_its_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    X.orders_log(spark, SF).write.parquet(path)
    out = C.capture_changes(spark.read.parquet(path), X.orders_now(spark, SF), X.ORDERS, 0, 10**12)
    assert not any("/log/" in f for f in out.inputFiles())  # the net change has been written, and is read instead


def test_change_sets_in_buckets_are_made_one_without_an_exchange(spark, tmp_path):
    root, sets = str(tmp_path), []
    for c in range(1, 4):
        data = [(k, None if k == 9 else f"{c}", 10 * c + k, "D" if k == c else "U") for k in range(c, 12)] + [(None, "n", c, "I")]
        df = spark.createDataFrame(data, CHANGES)
        df = df if c > 1 else df.drop("v")
        for _ in range(2):  # an attempt that is made again replaces itself
            bucketed.write_bucketed(df, root, "T", c, ("k",), buckets=3)
        sets.append((c, df))
    got = bucketed.consolidate_bucketed(spark, root, "t", [1, 2, 3], sets[-1][1], ("k",))
    assert rows(got.select("k", "v", VERSION, OP)) == rows(U.consolidate(sets, ("k",)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert rows(bucketed.consolidate_bucketed(spark, root, "t", [2], sets[-1][1], ("k",)).select("k", "v", VERSION, OP)) == rows(sets[1][1])


def test_views_wait_for_both_tables(spark):
    kinds = "table_name string, event_type string, column_name string, new_column_name string"
    views = spark.createDataFrame([("vwA",), ("vwAArchive",), ("vwB",)], "view_name string")
    columns = lambda a, b: spark.createDataFrame([("TBLA", *x) for x in a] + [("TBLAArchive", *x) for x in b] + [("TBLB", "x", "int")], "table_name string, column_name string, data_type string")
    asked = lambda event, a, b: rows(S.views_to_refresh(spark.createDataFrame([event], kinds), views, columns(a, b)).select("view_name"))
    both = [("vwA",), ("vwAArchive",)]
    assert asked(("TBLA", "Add", "x", None), [("x", "int")], [("k", "int")]) == [] and asked(("TBLA", "Drop", "x", None), [("k", "int")], [("x", "int")]) == []
    assert asked(("TBLAArchive", "Add", "x", None), [("x", "int")], [("X", "int")]) == both and asked(("TBLA", "Rename", "y", "x"), [("x", "int")], [("x", "int")]) == [("vwA",)]
    assert asked(("TBLA", "Modify", "x", None), [("x", "int")], [("x", "bigint")]) == [] and asked(("TBLB", "Add", "x", None), [], []) == [("vwB",)]


def stream(spark, tmp_path, batches, root, spec, **how):
    """Each list of rows as one micro-batch of a stream with a checkpoint of its own."""
    for n, data in enumerate(batches):
        source = str(tmp_path / f"{root}-{n}")
        spark.createDataFrame(data, CHANGES).coalesce(1).write.parquet(source)
        read = spark.readStream.schema(CHANGES).parquet(source)
        stream_apply(read, str(tmp_path / root), spec, f"{tmp_path}/{root}-c{n}", buckets=1, first_batch=n, **how).awaitTermination()


def test_a_stream_counts_live_rows(spark, tmp_path):
    """One insert, one update and one delete of live rows; a delete of none; a row put back; a replay."""
    spec, root = TableSpec("t", ("k",)), str(tmp_path / "r")
    first = [(1, "a", 1, "I"), (2, "b", 2, "I"), (3, None, 3, "D")]
    second = [(4, "d", 4, "I"), (1, "A", 5, "U"), (2, None, 6, "D"), (3, None, 2, "D")]
    stream(spark, tmp_path, [first, second, [(2, "back", 7, "I"), (1, "late", 1, "U")]], "r", spec)
    stored = store.target(spark, root, "t")
    again = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "r-2"))
    stream_apply(again, root, spec, f"{tmp_path}/again", first_batch=2).awaitTermination()
    got = {r.ctid: (r.rows, r.inserted, r.deleted) for r in store.read_ledger(spark, root, "stream").collect()}
    assert got == {0: (3, 2, 0), 1: (4, 2, 2), 2: (2, 1, 0)} and store.target(spark, root, "t") == stored
    assert rows(live(store.read_target(spark, root, spec))) == [(1, "A"), (2, "back"), (4, "d")]


def test_deleted_keys_are_forgotten(spark, tmp_path, monkeypatch):
    """Every batch deletes what the one before it put in: the keys that are remembered stay as many as the
    watermark's delay allows, over the micro-batches; late rows are kept aside and counted."""
    spec, root, seen = TableSpec("t", ("k",)), str(tmp_path / "r"), []
    source = tmp_path / "source"
    for n in range(16):
        data = [(10 * n + j, "x", 100 * n + j, "I") for j in range(10)] + [(10 * (n - 1) + j, None, 100 * n + 50 + j, "D") for j in range(10) if n]
        data += [(5, "late", 7, "U")] if n == 12 else []
        spark.createDataFrame(data, CHANGES).coalesce(1).write.mode("append").parquet(str(source))
    real = store.purge
    monkeypatch.setattr(store, "purge", lambda spark, root, spec, dead: (real(spark, root, spec, dead), seen.append(store.read_target(spark, root, spec).count()))[0])
    read = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream_apply(read, root, spec, f"{tmp_path}/checkpoint", buckets=1, delay=300, purge=5).awaitTermination()
    assert len(seen) == 3 and max(seen[1:]) <= 60
    assert rows(live(store.read_target(spark, root, spec))) == [(150 + j, "x") for j in range(10)]
    assert rows(read_late(spark, root, spec).select("k", "v", VERSION)) == [(5, "late", 7)]
    ledger = {r.ctid: r for r in store.read_ledger(spark, root, "stream").collect()}
    assert len(ledger) == 16 and sum(r.late for r in ledger.values()) == 1 and all((r.inserted, r.deleted) == (10, 10) for n, r in ledger.items() if n)
    assert len(pointers._numbers(spark, root)) <= pointers.KEPT + 2


def test_a_coordinator_needs_all_shards(spark, tmp_path):
    places = [("one", str(tmp_path / "one")), ("two", str(tmp_path / "two"))]
    spec, root = TableSpec("T", ("k",)), str(tmp_path / "all")
    for _, place in places:
        P.start_feed(spark, place, 7, ctid=3)
    assert P.coordinate(spark, [spec], places, root) == "started"
    ledgers = [store.read_ledger(spark, place, "publisher").where("ctid = 4").first() for _, place in places]
    assert [(r.sync_start_version, r.sync_bitwise) for r in ledgers] == [(7, 0), (7, 0)]
    catalog = spark.createDataFrame([("t", True, 0)], "table_name string, tracked boolean, min_valid_version long")
    log = spark.createDataFrame([(1, 9, "U")], "k int, version long, op string")
    for n, (_, place) in enumerate(places):
        assert P.coordinate(spark, [spec], places, root) == "waiting"
        base = spark.createDataFrame([(1, f"v{n}")], "k int, v string")
        plan, manifest, failed = P.publish_next(spark, {"T": (log, base)}, [spec], place, 20, catalog, sharded=True)
        assert (plan["ctid"], plan["sync_start_version"], plan["sync_stop_version"], failed) == (4, 7, 20, [])
        assert P.publish_next(spark, {"T": (log, base)}, [spec], place, 20, catalog, sharded=True) == (None, None, [])
    assert P.coordinate(spark, [spec], places, root) == "merged"
    assert rows(store.read_change_set(spark, root, "T", 4).select("k", "v")) == [(1, "v0")]
    assert store.read_ledger(spark, root, "publisher").where("ctid = 5").count() == 1


def test_unfit_tables_stop_or_are_left_out(spark, tmp_path):
    root, log, base = str(tmp_path), spark.createDataFrame([(1, 9, "U")], "k int, version long, op string"), spark.createDataFrame([(1, "v")], "k int, v string")
    specs = [TableSpec("T", ("k",)), TableSpec("old", ("k",), stop_on_error=False), TableSpec("none", ("k",), stop_on_error=False)]
    catalog = spark.createDataFrame([("t", True, 0), ("old", True, 8), ("x", True, 0)], "table_name string, tracked boolean, min_valid_version long")
    with pytest.raises(ValueError, match="no batch of this feed"):
        P.publish_next(spark, {}, specs, root, 20, catalog)
    P.start_feed(spark, root, 5)
    plan, manifest, failed = P.publish_next(spark, {s.name: (log, base) for s in specs}, specs, root, 20, catalog)
    assert sorted(name for name, _ in failed) == ["none", "old"] and rows(manifest.select("table_name", "expected_rows")) == [("T", 1)]
    with pytest.raises(ValueError, match="no longer valid"):
        P.publish_next(spark, {}, [TableSpec("old", ("k",))], root, 30, catalog.withColumn("min_valid_version", F.lit(99).cast("long")))


def test_every_row_is_in_one_range(spark):
    """Ranges part all keys, composite ones and such with nulls too, in whatever order the points are."""
    data = [(a, b) for a in ["a", "b", "it's", "", None] for b in [1, 2, 3, None]]
    df = spark.createDataFrame(data, "a string, b int")
    for points in ([], [("b", 2)], [("a", 2), ("b", 1), ("it's", 3)], [("it's", 3), ("a", 2), ("b", 1)]):
        found = jdbc.range_predicates(("a", "b"), points)
        assert len(found) == len(points) + 1
        sql = [p.replace("''", "\\'") for p in found]
        assert rows(df.select(sum(F.expr(f"if({p}, 1, 0)") for p in sql))) == [(1,)] * len(data)
    assert re.fullmatch(r"\{ts '2024-01-02 03:04:05.000006'\}", jdbc.literal(__import__("datetime").datetime(2024, 1, 2, 3, 4, 5, 6)))
    with pytest.raises(ValueError, match="not supported"):
        jdbc.jdbc_copy(spark, {"flavor": "mysql"}, {"flavor": "netezza"})
