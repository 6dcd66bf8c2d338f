"""Stored targets: changes laid beside parts, key ranges, column names, two writers, leases."""

from __future__ import annotations

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import apply as A
from tidemark.sources import pointers, store
from tidemark.spec import OP, VERSION, TableSpec

CHANGES = f"k int, v string, {VERSION} long, {OP} string"
T1 = TableSpec("t", ("k",))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def loaded(spark, root, n=1000, **how):
    store.initial_load(spark.createDataFrame([(k, f"v{k}") for k in range(n)], "k int, v string"), T1, root, **how)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/target") for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize(("layout", "method"), [("hash", "merge"), ("range", "merge"), ("hash", "replace"), ("range", "delete_insert")])
def test_any_sequence_equals_the_rewritten_table(spark, tmp_path, monkeypatch, layout, method):
    """Applies laid beside, folded and written anew by turns, with null keys, keys that differ by case,
    repeated keys in the target and changed columns, against the same applies to the plain table."""
    plain = {"merge": A.apply_merge, "delete_insert": A.apply_delete_insert, "replace": A.apply_replace}[method]
    rng = random.Random(f"{layout}{method}")
    spec, root = TableSpec("T", ("a", "b"), ignore_case=True, method=method), str(tmp_path)
    schema = "a string, b int, v string, w double"
    start = [(rng.choice("xyzXYZ") + str(n % 40), rng.choice([1, 2, None]), f"v{n}", n / 2) for n in range(300)]
    want = spark.createDataFrame(start, schema)
    store.initial_load(want, spec, root, buckets=4, layout=layout)
    want = spark.createDataFrame(want.collect(), schema)
    beside = 0
    for n, share in enumerate([0, 0, 10**9, 0, 2]):
        monkeypatch.setattr(store, "SHARE", share)
        monkeypatch.setattr(store, "BESIDE", 60 if n == 3 else 10**6)
        changed = {}
        for _ in range(25):
            a, b = rng.choice("xyzXYZ") + str(rng.randrange(50)), rng.choice([1, 2, 3, None])
            changed[(a.upper(), b) if b is not None else len(changed)] = (a, b, None if n % 2 else f"n{n}", float(n), 100 + n, rng.choice("IUD"))
        changes = spark.createDataFrame(list(changed.values()), f"{schema}, {VERSION} long, {OP} string")
        changes = changes.drop("w") if n == 2 else changes
        store.apply_to_buckets(spark, changes, spec, root)
        want = spark.createDataFrame(plain(want, changes, spec).collect(), schema)
        assert rows(store.read_target(spark, root, spec)) == rows(want), n
        beside += len(store.target(spark, root, "T").deltas)
    assert beside
    store.vacuum(spark, root)
    assert rows(store.read_target(spark, root, spec)) == rows(want)


def test_counts_are_those_of_the_plain_merge(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    loaded(spark, root)
    sent = [(1, "a", 1, "U"), (2, None, 1, "D"), (3, "c", 1, "I"), (5000, "new", 1, "I"), (6000, None, 1, "D"), (None, "null", 1, "I")]
    changes = spark.createDataFrame(sent, CHANGES)
    plain = A.apply_counts(store.read_target(spark, root, T1), changes, T1).first()
    did = store.apply_to_buckets(spark, changes, T1, root)
    t = store.target(spark, root, "t")
    assert t.deltas and (did.inserted, did.deleted) == tuple(plain) == (4, 3)
    again = store.apply_to_buckets(spark, spark.createDataFrame([(2, "back", 2, "I"), (5000, None, 2, "D"), (1, "b", 2, "U")], CHANGES), T1, root)
    assert (again.inserted, again.deleted) == (2, 2)
    got = {r[0]: r[1] for r in rows(store.read_target(spark, root, T1))}
    assert got[1] == "b" and got[2] == "back" and 5000 not in got and got[None] == "null" and len(got) == 1001


def test_what_lies_beside_grows_and_is_folded(spark, tmp_path):
    """A part is written anew once an eighth of it has changed, and reading never broadcasts more than a
    bound; small change sets leave its files alone."""
    root = str(tmp_path)
    loaded(spark, root)
    before = store.target(spark, root, "t")
    seen = []
    for n in range(6):
        store.apply_to_buckets(spark, spark.createDataFrame([(k, f"n{n}", n, "U") for k in range(n * 40, n * 40 + 40)], CHANGES), T1, root)
        t = store.target(spark, root, "t")
        seen.append((t.places == before.places, sum(t.delta_sizes.values())))
    assert seen[:3] == [(True, 40), (True, 80), (True, 120)] and seen[3] == (False, 0) and seen[4][1] == 40
    plan = store.read_target(spark, root, T1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_an_apply_looks_up_keys_alone(spark, tmp_path):
    """Of the target only the key is read where all other columns are sent."""
    root = str(tmp_path)
    store.initial_load(spark.range(1000).selectExpr("cast(id as int) k", "'x' v", "'y' w"), T1, root)
    t = store.target(spark, root, "t")
    hit = store._rows(spark, root, T1, t, [0], ("_bucket",))
    changes = spark.createDataFrame([(1, "a", "b", 0, 1, "U")], f"k int, v string, w string, _bucket int, {VERSION} long, {OP} string")
    plan = A.merged(hit, changes, T1, hit_only=True)._jdf.queryExecution().executedPlan().toString()
    assert [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line] == ["struct<k:int>"]


# ranges


def test_ranges_follow_neighbouring_keys(spark, tmp_path, monkeypatch):
    """A change set of neighbouring keys reads and writes under a twentieth of the parts; text and
    composite keys have ranges too."""
    root = str(tmp_path)
    spec = TableSpec("r", ("a", "b"))
    df = spark.range(40_000).selectExpr("concat('k', lpad(cast(id div 10 as string), 6, '0')) a", "cast(id % 10 as int) b", "id v")
    store.initial_load(df.repartition(4, "v"), spec, root, buckets=64, layout="range")
    t = store.target(spark, root, "r")
    assert t.buckets > 48 and max(t.sizes.values()) < 3 * min(t.sizes.values())
    keys = spark.range(9000, 9600).selectExpr("concat('k', lpad(cast(id div 10 as string), 6, '0')) a", "cast(id % 10 as int) b")
    assert 1 <= len(store.touched_parts(t, keys, spec)) <= 3 and len(store.touched_parts(t, keys.limit(0), spec)) == 0
    near = store.read_touched(spark, root, spec, keys)
    assert near.join(keys, ["a", "b"]).count() == 600 and len(near.inputFiles()) * 20 < len(files(root))
    changes = keys.selectExpr("a", "b", "cast(-1 as long) v", f"cast(1 as long) {VERSION}", f"'U' {OP}")
    monkeypatch.setattr(store, "SHARE", 10**9)
    did = store.apply_to_buckets(spark, changes, spec, root)
    assert len(did.buckets) <= 3 and (did.inserted, did.deleted) == (600, 600)
    outside = spark.createDataFrame([("a", 1, 5, 2, "I"), ("z", 1, 6, 2, "I"), ("k000500", 77, 7, 2, "I"), (None, 1, 8, 2, "I")], f"a string, b int, v long, {VERSION} long, {OP} string")
    store.apply_to_buckets(spark, outside, spec, root)
    got = store.read_target(spark, root, spec)
    assert got.count() == 40_004 and got.where("v = -1").count() == 600 and rows(got.where("v in (5, 6, 7, 8) and b in (1, 77) and (a in ('a', 'z') or b = 77 or a is null)").select("v")) == [(5,), (6,), (7,), (8,)]
    after = store.target(spark, root, "r")
    again = spark.createDataFrame([("a", 1), ("z", 1)], "a string, b int")
    assert len(store.touched_parts(after, again, spec)) == 2 and store.read_touched(spark, root, spec, again).join(again, ["a", "b"]).count() == 2


def test_ranges_of_few_keys(spark, tmp_path):
    for n, data in enumerate(([], [(None, "x")], [(1, "a")] * 50, [(1, "a"), (2, "b"), (None, "c")])):
        root = str(tmp_path / str(n))
        store.initial_load(spark.createDataFrame(data, "k int, v string"), T1, root, buckets=4, layout="range")
        store.apply_to_buckets(spark, spark.createDataFrame([(1, "new", 1, "U"), (9, "nine", 1, "I")], CHANGES), T1, root)
        want = sorted([(k, "new" if k == 1 else v) for k, v in data] + [(9, "nine")] + ([] if any(k == 1 for k, _ in data) else [(1, "new")]), key=repr)
        assert rows(store.read_target(spark, root, T1)) == want


# columns


def test_evolution_writes_no_rows(spark, tmp_path):
    root = str(tmp_path)
    store.initial_load(spark.range(100).selectExpr("cast(id as int) k", "cast(id as string) v", "cast(id as int) n", "cast(id as decimal(9,2)) d"), T1, root)
    store.apply_to_buckets(spark, spark.createDataFrame([(1, "one", 1, 1.5, 1, "U")], f"k int, v string, n int, d double, {VERSION} long, {OP} string"), T1, root)
    before, first = files(root), rows(store.read_target(spark, root, T1))
    step = lambda kind, c, **more: {"event_type": kind, "column_name": c} | more
    steps = [step("Rename", "v", new_column_name="name"), step("Drop", "n"), step("Add", "n", data_type="varchar"), step("Add", "v", data_type="int"), step("Rename", "gone", new_column_name="x"), step("Modify", "d", data_type="decimal", precision=14, scale=4)]
    assert store.evolve_target(spark, root, T1, steps) and not store.evolve_target(spark, root, T1, steps[4:])
    now = store.read_target(spark, root, T1)
    assert files(root) == before and now.dtypes == [("k", "int"), ("name", "string"), ("d", "decimal(14,4)"), ("n", "string"), ("v", "int")]
    assert [(k, name, n, v) for k, name, _, n, v in rows(now)] == [(k, v, None, None) for k, v, _, _ in first]
    changes = spark.createDataFrame([(5, "five", "text", 55, 2, "U"), (500, "new", "x", 1, 2, "I")], f"k int, name string, n string, v int, {VERSION} long, {OP} string")
    store.apply_to_buckets(spark, changes, T1, root)
    got = {r.k: r for r in store.read_target(spark, root, T1).collect()}
    assert (got[5].name, got[5].n, got[5].v, float(got[5].d)) == ("five", "text", 55, 5.0) and got[500].d is None and got[6].name == "6" and got[1].name == "one"
    assert store.evolve_target(spark, root, T1, [step("Rename", "v", new_column_name="w"), step("Rename", "name", new_column_name="v"), step("Drop", "w")])
    assert {r.k: r.v for r in store.read_target(spark, root, T1).collect()}[5] == "five"
    held = files(root)
    assert store.evolve_target(spark, root, T1, [step("Modify", "d", data_type="varchar")]) and files(root) > held  # no file can be read so
    got = {r.k: r for r in store.read_target(spark, root, T1).collect()}
    assert got[5].d == "5.0000" and got[5].v == "five" and got[5].n == "text" and len(got) == 101


# writers and readers


def test_two_writers_lose_nothing(spark, tmp_path):
    """Appliers of two threads at once, of the same parts and of different ones."""
    root = str(tmp_path)
    loaded(spark, root, 400, buckets=4)
    failed = []

    def work(who):
        try:
            for n in range(3):
                sent = [(k, f"{who}{n}", n, "U") for k in range(who, 400, 40)] + [(1000 + 10 * n + who, "new", n, "I")]
                store.apply_to_buckets(spark, spark.createDataFrame(sent, CHANGES), T1, root)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(who,)) for who in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = {r.k: r.v for r in store.read_target(spark, root, T1).collect()}
    assert len(got) == 406 and {got[k] for k in range(1, 400, 40)} == {"12"} and {got[k] for k in range(2, 400, 40)} == {"22"}
    assert pointers.snapshot(spark, root).seq == 7


def test_the_second_writer_is_rebased_or_starts_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    loaded(spark, root, 400, buckets=8)
    real, made = store.rewrite, []
    bucket = {r.k: r.b for r in store.read_target(spark, root, T1).select("k", store.bucket_of(store.read_target(spark, root, T1), T1, 8).alias("b")).collect()}
    far = next(k for k in bucket if bucket[k] != bucket[0])

    def between(other):
        def late(*args, **kw):
            out = real(*args, **kw)
            made.append(1)
            if len(made) == 1:
                with monkeypatch.context() as m:
                    m.setattr(store, "rewrite", real)
                    store.apply_to_buckets(spark, spark.createDataFrame([(other, "other", 1, "U")], CHANGES), T1, root)
            return out

        return late

    for other, times in ((far, 1), (0, 2)):
        made.clear()
        monkeypatch.setattr(store, "rewrite", between(other))
        store.apply_to_buckets(spark, spark.createDataFrame([(0, f"mine{times}", 2, "U")], CHANGES), T1, root)
        got = {r.k: r.v for r in store.read_target(spark, root, T1).collect()}
        assert len(made) == times and got[0] == f"mine{times}" and got[far] == "other" and len(got) == 400


def test_commits_cost_the_same_however_many(spark, tmp_path):
    root = str(tmp_path)
    loaded(spark, root, 10)
    t = store.target(spark, root, "t")
    for _ in range(150):
        store.commit(spark, root, {"t": t})
    assert pointers.snapshot(spark, root).seq == 151 and len(os.listdir(f"{root}/pointers")) <= 2 * (pointers.KEPT + 2)
    store.vacuum(spark, root)
    assert len([n for n in os.listdir(f"{root}/pointers") if n.endswith(".json")]) == 1 and len([n for n in os.listdir(f"{root}/states") if n.endswith(".json")]) == 1
    assert store.read_target(spark, root, T1).count() == 10


def test_a_leased_reader_survives_vacuum(spark, tmp_path):
    root = str(tmp_path)
    loaded(spark, root, 100)
    before = rows(store.read_target(spark, root, T1))
    with pointers.lease(spark, root) as held:
        old = store.read_target(spark, root, T1, held)
        everything = spark.createDataFrame([(k, "new", 1, "U") for k in range(100)], CHANGES)
        store.apply_to_buckets(spark, everything, T1, root)
        store.vacuum(spark, root)
        assert rows(old) == before == rows(store.read_target(spark, root, T1, held))
        assert {r.v for r in store.read_target(spark, root, T1).collect()} == {"new"}
    assert store.vacuum(spark, root) and store.vacuum(spark, root) == []
    with pytest.raises(RuntimeError, match="lease"):
        store.read_target(spark, root, T1, held)
    with pointers.lease(spark, root, seconds=-1):
        assert pointers.leased(spark, root) == set()


def test_ledgers_are_put_together_and_trimmed(spark, tmp_path):
    root = str(tmp_path)
    for n in range(120):
        store.record_rows(spark, root, "publisher", [{"feed": "f", "ctid": n // 3, "bits": n % 3, "at": None}], "feed string, ctid long, bits int, at timestamp")
    store.record(spark, root, "publisher", spark.createDataFrame([("f", 39, 9, 1.5)], "feed string, ctid long, bits int, more double"))
    assert len(os.listdir(f"{root}/ledgers/publisher")) < 2 * store.RECORDS
    got = {r.ctid: (r.bits, r.more) for r in store.read_ledger(spark, root, "publisher").collect()}
    assert len(got) == 40 and got[0] == (2, None) and got[39] == (9, 1.5)
    assert store.trim_ledger(spark, root, "publisher", F.col("ctid") < 30) == 30 and store.trim_ledger(spark, root, "publisher", F.col("ctid") < 31) == 1
    store.record_rows(spark, root, "publisher", [{"feed": "f", "ctid": 50, "bits": 1}], "feed string, ctid long, bits int")
    assert sorted(r.ctid for r in store.read_ledger(spark, root, "publisher").collect()) == [*range(31, 40), 50]
