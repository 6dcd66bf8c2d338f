"""Publishing, applying and merging whole batches.

Each flow works step by step on the tables of a batch, with a job per table.  What is done is kept as
progress bits in a ledger, so a run that failed is resumed where it stopped: steps whose bit is set
are skipped, and every step can be repeated.  A failing table becomes a row of the error log unless
its spec says to stop.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import APPLY, APPLY_SCHEMA, CAPTURE, COMPLETE, CONSOLIDATE, DOWNLOAD, HISTORY, PUBLISH_SCHEMA, UPLOAD
from tidemark.operators import schema as S
from tidemark.operators.apply import pair_archives, union_all
from tidemark.operators.changes import capture_changes, dedupe_changes
from tidemark.operators.consolidate import consolidate
from tidemark.operators.errors import log_errors
from tidemark.operators.ledger import finish_init, last_start_time, plan_batch, resize_batches, table_start_versions, validate_sources
from tidemark.operators.manifest import audit_counts, build_manifest, spec_table
from tidemark.operators.retention import check_retention, expired_ctids, trim_log
from tidemark.operators.shards import merge_manifests, merge_shards, next_shard_versions, revert, schemas_out_of_sync, shards_ready
from tidemark.sources import pointers, store
from tidemark.sources.paths import children, read_text, write_new, write_text
from tidemark.spec import OP, TableSpec

Failure = tuple[str, str]
STEPS = "steps array<struct<step: string, began: timestamp, ended: timestamp, rows: bigint>>"
LEDGER = f"feed string, ctid long, sync_start_version long, sync_stop_version long, sync_start_time timestamp, sync_stop_time timestamp, sync_bitwise int, mode string, {STEPS}"
COUNTS = "table_name string, inserted long, deleted long"


def each(specs: list[TableSpec], work: Callable[[TableSpec], None]) -> list[Failure]:
    """``work`` per table; failures of tables that don't stop the run are returned."""
    failed = []
    for s in specs:
        try:
            work(s)
        except Exception as e:
            if s.stop_on_error:
                raise
            failed.append((s.name, f"Table: {s.name}\n{e}"))
    return failed


class Progress:
    """The ledger rows of batches that are worked on together, with the steps done so far."""

    def __init__(self, spark: SparkSession, root: str, name: str, feed: str, ctids: list[int], **fresh):
        self.spark, self.root, self.name, self.last = spark, root, name, max(ctids)
        row = {"feed": feed, "sync_start_version": None, "sync_stop_version": None, "sync_start_time": dt.datetime.now(), "sync_stop_time": None, "sync_bitwise": 0, "mode": None, "steps": []} | fresh
        self.rows = {c: row | {"ctid": c, "steps": []} for c in sorted(ctids)}
        have = store.recorded(spark, root, name)
        if have is not None:
            have = have.where((F.col("feed") == feed) & F.col("ctid").isin(list(self.rows)))
            for r in sorted(have.collect(), key=lambda r: r["seq"]):
                self.rows[r["ctid"]] = {k: v for k, v in r.asDict(recursive=True).items() if k != "seq"}

    def has(self, bit: int, ctid: int | None = None) -> bool:
        return self.rows[self.last if ctid is None else ctid]["sync_bitwise"] & bit > 0

    def set(self, *bits: int, ctids: list[int] | None = None, done: bool = False, record: bool = True) -> None:
        """Bits set for some batches (all if None); a step that did nothing needn't be recorded at once."""
        for c in self.rows if ctids is None else ctids:
            for b in bits:
                self.rows[c]["sync_bitwise"] |= b
            if done:
                self.rows[c]["sync_stop_time"] = dt.datetime.now()
        if record:
            store.record_rows(self.spark, self.root, self.name, list(self.rows.values()), LEDGER)

    @contextmanager
    def step(self, name: str):
        """Times a step; the caller puts its rows into the list it gets."""
        began, rows = dt.datetime.now(), [0]
        yield rows
        self.rows[self.last]["steps"].append({"step": name, "began": began, "ended": dt.datetime.now(), "rows": rows[0]})


def read_steps(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(feed, ctid, step, began, ended, rows) of all batches of a ledger."""
    return store.read_ledger(spark, root, name).select("feed", "ctid", F.explode("steps").alias("x")).select("feed", "ctid", "x.*")


def log_failures(spark: SparkSession, root: str, agent: str, failed: list[Failure]) -> None:
    """Failed tables as rows of the error log."""
    if failed:
        rows = spark.createDataFrame([(None, "Error", text) for _, text in failed], "id long, level string, message string").withColumn("log_date", F.current_timestamp())
        log_errors(rows, agent, root, "").coalesce(1).write.mode("append").parquet(f"{root}/errors")


def publish(
    spark: SparkSession, sources: dict[str, tuple[DataFrame, DataFrame]], specs: list[TableSpec], root: str, ctid: int, start: int, stop: int,
    events: DataFrame | None = None, columns: DataFrame | None = None, feed: str = "", starts: dict[str, int] | None = None,
) -> tuple[DataFrame, list[Failure]]:
    """Capture (log, base) of every table into change sets of ``ctid``; returns the manifest.

    ``starts`` (table in lower case) are start versions of tables that have their own.  With DDL ``events`` (id, ts, xml) and the catalog's ``columns``, schema changes since the start of
    the last uploaded batch are published too."""
    p = Progress(spark, root, "publisher", feed, [ctid], sync_start_version=start, sync_stop_version=stop)
    failed: list[Failure] = []
    if not p.has(CAPTURE):
        with p.step("CaptureChanges"):
            failed = each(specs, lambda s: store.write_change_set(capture_changes(*sources[s.name], s, (starts or {}).get(s.name.lower(), start), stop), root, s.name, ctid))
        log_failures(spark, root, "publisher", failed)
        p.set(CAPTURE)
    if not p.has(PUBLISH_SCHEMA):
        if events is not None:
            with p.step("PublishSchemaChanges"):
                ledger = store.read_ledger(spark, root, "publisher").where(F.col("feed") == feed)
                since = last_start_time(ledger, F.lit(ctid), UPLOAD, F.lit("1970-01-01").cast("timestamp")).first()["last_start_time"]
                S.publish_schema_changes(events, columns, specs, since).write.mode("overwrite").parquet(f"{root}/schema_changes/ctid={ctid}")
        p.set(PUBLISH_SCHEMA, record=events is not None)
    with p.step("PublishManifest") as n:
        parts = []
        for s in specs:
            df = store.read_change_set(spark, root, s.name, ctid)
            if df is not None:
                parts.append(df.select(F.lit(s.schema).alias("schema_name"), F.lit(s.name).alias("table_name"), OP))
        empty = spark.createDataFrame([], f"schema_name string, table_name string, {OP} string")
        build_manifest(union_all([empty, *parts]), spec_table(spark, specs)).withColumn("ctid", F.lit(ctid).cast("long")).write.mode("overwrite").parquet(f"{root}/manifest/ctid={ctid}")
        manifest = spark.read.parquet(f"{root}/manifest/ctid={ctid}").withColumn("ctid", F.lit(ctid).cast("long"))
        n[0] = manifest.agg(F.sum("expected_rows")).first()[0] or 0
    if not p.has(UPLOAD):
        p.set(UPLOAD, done=True)
    return manifest, failed


def apply_schema_changes(spark: SparkSession, specs: list[TableSpec], relay: str, root: str, ctid: int) -> DataFrame | None:
    """The schema changes of a published batch applied to targets and histories; returns those that
    applied.  A batch has a handful of them per table."""
    path = f"{relay}/schema_changes/ctid={ctid}"
    if not store.exists(spark, path):
        return None
    changes = S.applicable_changes(spark.read.parquet(path), specs)
    steps = [r.asDict() for r in changes.orderBy("event_id").collect()]
    for s in specs:
        own = [x for x in steps if (x["schema_name"] or "dbo").lower() == s.schema.lower() and x["table_name"].lower() == s.name.lower()]
        if not own:
            continue
        store.evolve_target(spark, root, s, own)
        if s.history:
            store.evolve_history(spark, root, s.name, ctid, own)
    return changes


def apply_batch(
    spark: SparkSession, specs: list[TableSpec], relay: str, root: str, ctids: list[int], feed: str = "", until: int = HISTORY,
    refresh: Callable[[list[str]], None] | None = None, views: DataFrame | None = None,
) -> tuple[DataFrame, list[Failure]]:
    """Apply one published batch, or several merged into one under the last ctid, to the subscriber's
    store ``root``; a table and its archive change together.  Returns applied counts per table.

    The steps are schema changes, consolidation, download, apply and history.  ``until`` names the bit
    of the last step to do now: outside its full-run hours a subscriber goes up to ``APPLY_SCHEMA``.
    ``refresh`` gets the names of the ``views`` over tables whose schema changed."""
    last, mode = max(ctids), "merged" if len(ctids) > 1 else "single"
    p = Progress(spark, root, "subscriber", feed, ctids, mode=mode)
    for c in sorted(ctids):
        if not p.has(APPLY_SCHEMA, c):
            changed = None
            with p.step("ApplySchemaChanges"):
                changed = apply_schema_changes(spark, specs, relay, root, c)
                if changed is not None and views is not None and refresh is not None:
                    names = [r["view_name"] for r in S.views_to_refresh(changed, views, target_columns(spark, specs, root)).collect()]
                    if names:
                        refresh(names)
            p.set(APPLY_SCHEMA, ctids=[c], record=changed is not None or (until == APPLY_SCHEMA and c == last))
    by_name = {s.name.lower(): s for s in specs}
    counts: list[tuple] = []
    failed: list[Failure] = []

    def fetch(s: TableSpec) -> None:
        found = [(c, df) for c in sorted(ctids) if (df := store.read_change_set(spark, relay, s.name, c)) is not None]
        if found:
            store.write_change_set(consolidate(found, s.pk) if len(found) > 1 else dedupe_changes(found[0][1], s.pk), root, s.name, last)

    if until >= DOWNLOAD and not p.has(DOWNLOAD):
        with p.step("DownloadChanges"):
            failed += each(specs, fetch)
        p.set(CONSOLIDATE, DOWNLOAD, ctids=[last])
    if until >= APPLY and not p.has(APPLY):
        with p.step("ApplyChanges") as n:
            sets = {k: df for k, s in by_name.items() if (df := store.read_change_set(spark, root, s.name, last)) is not None}
            units = pair_archives(spark.createDataFrame([(k,) for k in sets], "table_name string")).collect() if sets else []
            groups = {u["table_name"]: [x for x in (u["table_name"], u["archive_name"]) if x] for u in units}

            known = pointers.snapshot(spark, root).notes
            note = lambda name: f"applied/{feed}/{name.lower()}"

            def unit(s: TableSpec) -> None:
                group = [(by_name[x], sets[x]) for x in groups[s.name.lower()]]
                told = [known.get(note(spec.name)) for spec, _ in group]
                if all(t is not None and t[0] == last for t in told):  # came into force in a run that failed later
                    counts.extend((spec.name, t[1], t[2]) for (spec, _), t in zip(group, told, strict=True))
                    return
                notes = lambda did: {note(spec.name): [last, d.inserted, d.deleted] for (spec, _), d in zip(group, did, strict=True)}
                for (spec, _), did in zip(group, store.apply_group(spark, root, group, notes), strict=True):
                    counts.append((spec.name, did.inserted, did.deleted))

            failed += each([by_name[k] for k in groups], unit)
            n[0] = sum(c[1] for c in counts)
        applied = spark.createDataFrame(counts, COUNTS)
        applied.coalesce(1).write.mode("overwrite").parquet(f"{root}/applied/ctid={last}")
        audit(spark, specs, relay, root, ctids, applied)
        p.set(APPLY, ctids=[last])
    if until >= HISTORY and not p.has(HISTORY):
        with p.step("SyncHistoryTables"):
            for s in specs:
                df = store.read_change_set(spark, root, s.name, last) if s.history else None
                if df is not None:
                    store.append_history(df, last, root, s.name)
        p.set(COMPLETE, done=True)
    log_failures(spark, root, "subscriber", failed)
    path = f"{root}/applied/ctid={last}"
    return spark.read.schema(COUNTS).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], COUNTS), failed


def target_columns(spark: SparkSession, specs: list[TableSpec], root: str) -> DataFrame:
    """(table_name, column_name, data_type) of the subscriber's targets as they are now."""
    found = [(s.name, t) for s in specs if (t := store.target(spark, root, s.name)) is not None]
    return spark.createDataFrame([(name, f.name, f.dataType.simpleString()) for name, t in found for f in t.schema], "table_name string, column_name string, data_type string")


def audit(spark: SparkSession, specs: list[TableSpec], relay: str, root: str, ctids: list[int], applied: DataFrame) -> None:
    """Expected against applied rows of the batches, a row a table, kept under the last ctid.

    One batch is held against its manifest; batches merged into one, where a key counts once, against the
    change sets that were made of them."""
    last = max(ctids)
    if len(ctids) == 1 and store.exists(spark, f"{relay}/manifest/ctid={last}"):
        expected = spark.read.parquet(f"{relay}/manifest/ctid={last}")
    else:
        sets = [(s, df) for s in specs if (df := store.read_change_set(spark, root, s.name, last)) is not None]
        parts = [df.select(F.lit(s.schema).alias("schema_name"), F.lit(s.name).alias("table_name"), OP) for s, df in sets]
        empty = spark.createDataFrame([], f"schema_name string, table_name string, {OP} string")
        expected = build_manifest(union_all([empty, *parts]), spec_table(spark, specs))
    schemas = {s.name.lower(): s.schema for s in specs}
    named = applied.withColumn("schema_name", F.create_map(*[F.lit(x) for kv in schemas.items() for x in kv])[F.lower("table_name")])
    found = audit_counts(expected, named).coalesce(1)
    found.write.mode("overwrite").parquet(f"{root}/audit/ctid={last}")


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """(schema_name, table_name, expected, inserted, percent, error, ctid) of all batches applied."""
    return spark.read.parquet(f"{root}/audit").withColumn("ctid", F.col("ctid").cast("long"))


INIT = "feed string, table_name string, next_version long, in_progress boolean, started timestamp, finished timestamp"


def start_feed(spark: SparkSession, root: str, version: int, ctid: int = 0, feed: str = "") -> None:
    """The first row of a publisher's ledger: the version from which the first batch goes on."""
    now = dt.datetime.now()
    row = {"feed": feed, "ctid": ctid, "sync_start_version": version, "sync_stop_version": version, "sync_start_time": now, "sync_stop_time": now, "sync_bitwise": UPLOAD | CAPTURE | PUBLISH_SCHEMA, "mode": None, "steps": []}
    store.record_rows(spark, root, "publisher", [row], LEDGER)


def begin_init(spark: SparkSession, root: str, table: str, version: int, feed: str = "") -> None:
    """A table is being loaded: it is left out of batches until ``end_init``, then captured from ``version``."""
    store.record_rows(spark, root, "init", [{"feed": feed, "table_name": table, "next_version": version, "in_progress": True, "started": dt.datetime.now(), "finished": None}], INIT)


def end_init(spark: SparkSession, root: str, table: str, feed: str = "") -> None:
    rows = store.read_ledger(spark, root, "init", ("feed", "table_name")).where((F.col("feed") == feed) & (F.lower("table_name") == table.lower()))
    store.record_rows(spark, root, "init", [r.asDict() for r in finish_init(rows, F.lit(True), F.current_timestamp()).select("feed", "table_name", "next_version", "in_progress", "started", "finished").collect()], INIT)


def publish_next(
    spark: SparkSession, sources: dict[str, tuple[DataFrame, DataFrame]], specs: list[TableSpec], root: str, version: int, catalog: DataFrame,
    events: DataFrame | None = None, columns: DataFrame | None = None, feed: str = "", most: int = 0, hours: tuple[str | None, str | None] = (None, None), sharded: bool = False,
) -> tuple[dict | None, DataFrame | None, list[Failure]]:
    """Plan the feed's next batch from its ledger up to ``version``, and publish it; returns the plan.

    The batch is a new one, one that is taken up again, or, where shards are coordinated, none until the
    coordinator has made one (plan None).  Batches of more than ``most`` versions are cut, except in the
    ``hours``.  Tables that are being loaded are left out, tables just loaded begin at their own version,
    and tables that the ``catalog`` (table_name, tracked, min_valid_version) shows to be unfit are
    failures, or stop the run where their spec says so."""
    ledger = store.read_ledger(spark, root, "publisher")
    empty = spark.createDataFrame([], LEDGER)
    ledger = (empty if ledger is None else ledger).where(F.col("feed") == feed)
    plans = plan_batch(ledger, spark.createDataFrame([(feed, version)], "feed string, current_version long"), sharded).withColumn("current_version", F.lit(version).cast("long"))
    fresh = F.col("plan").isin("new", "retry")
    cut = resize_batches(plans.where(fresh), most, F.current_timestamp(), *hours, current="current_version")
    plan = cut.unionByName(plans.where(~F.coalesce(fresh, F.lit(False)))).first().asDict()
    if plan["error"]:
        raise ValueError(f"feed {feed!r}: {plan['error']}")
    if plan["plan"] == "wait":
        return None, None, []
    ctid, start, stop = plan["ctid"], plan["sync_start_version"], plan["sync_stop_version"]
    wanted = spark.createDataFrame([(feed, s.name.lower()) for s in specs], "feed string, table_name string")
    listed = catalog.select(F.lit(feed).alias("feed"), F.lower("table_name").alias("table_name"), "tracked", "min_valid_version")
    registry = store.read_ledger(spark, root, "init", ("feed", "table_name"))
    registry = (spark.createDataFrame([], INIT) if registry is None else registry).withColumn("table_name", F.lower("table_name"))
    tables = wanted.join(listed.select("feed", "table_name", "min_valid_version"), ["feed", "table_name"], "left")
    batch = spark.createDataFrame([(feed, ctid, start)], "feed string, ctid long, sync_start_version long")
    judged = {r["table_name"]: r for r in validate_sources(table_start_versions(batch, tables, registry), listed).collect()}
    unfit = {k: r["reason"] for k, r in judged.items() if r["reason"] is not None}

    def check(s: TableSpec) -> None:
        if s.name.lower() in unfit:
            raise ValueError(f"{s.schema}.{s.name}: {unfit[s.name.lower()]}")

    failed = each(specs, check)
    log_failures(spark, root, "publisher", failed)
    fit = [s for s in specs if s.name.lower() in judged and s.name.lower() not in unfit]
    began = dt.datetime.now()
    manifest, more = publish(spark, sources, fit, root, ctid, start, stop, events, columns, feed, {k: r["start_version"] for k, r in judged.items()})
    store.trim_ledger(spark, root, "init", (F.col("feed") == feed) & ~F.col("in_progress") & (F.col("finished") < F.lit(began)), ("feed", "table_name"))
    return plan, manifest, failed + more


def merge_batch(spark: SparkSession, specs: list[TableSpec], shards: list[tuple[str, str]], root: str, ctid: int) -> list[Failure]:
    """The change sets of all shards (name, root), master first, as those of one database."""

    def one(s: TableSpec) -> None:
        found = [(name, df) for name, place in shards if (df := store.read_change_set(spark, place, s.name, ctid)) is not None]
        if found:
            store.write_change_set(merge_shards(found, s.pk, [n for n, _ in shards]), root, s.name, ctid)

    return each(specs, one)


def _change_columns(spark: SparkSession, specs: list[TableSpec], shards: list[tuple[str, str]], ctid: int) -> DataFrame:
    """(shard, table_name, column_name, is_pk, data_type) of the change sets that there are."""
    rows = []
    for s in specs:
        pk = {c.lower() for c in s.pk}
        for name, place in shards:
            df = store.read_change_set(spark, place, s.name, ctid)
            rows += [] if df is None else [(name, s.name, f.name, f.name.lower() in pk, f.dataType.simpleString()) for f in df.schema]
    return spark.createDataFrame(rows, "shard string, table_name string, column_name string, is_pk boolean, data_type string")


def _shard_ledgers(spark: SparkSession, shards: list[tuple[str, str]], feed: str) -> DataFrame:
    parts = [df.where(F.col("feed") == feed).withColumn("shard", F.lit(name)) for name, place in shards if (df := store.read_ledger(spark, place, "publisher")) is not None]
    return union_all([spark.createDataFrame([], f"{LEDGER}, shard string"), *parts])


def _next_shard_batches(spark: SparkSession, shards: list[tuple[str, str]], root: str, feed: str, ctid: int) -> None:
    """A batch ``ctid`` for every shard, from its own last stop on, and for the coordinator; those that are
    there already are left."""
    ledgers = _shard_ledgers(spark, shards, feed)
    there = {r["shard"] for r in ledgers.where(F.col("ctid") == ctid).select("shard").distinct().collect()}
    starts = {r["shard"]: r["sync_start_version"] for r in next_shard_versions(ledgers.where(F.col("ctid") < ctid)).collect()}
    row = {"feed": feed, "ctid": ctid, "sync_stop_version": None, "sync_start_time": dt.datetime.now(), "sync_stop_time": None, "sync_bitwise": 0, "mode": None, "steps": []}
    for name, place in shards:
        if name not in there:
            store.record_rows(spark, place, "publisher", [row | {"sync_start_version": starts.get(name, 0)}], LEDGER)
    store.record_rows(spark, root, "publisher", [row | {"sync_start_version": None}], LEDGER)


def coordinate(spark: SparkSession, specs: list[TableSpec], shards: list[tuple[str, str]], root: str, feed: str = "") -> str:
    """One step of the shards' (name, store; master first) common batch, in the coordinator's store
    ``root``, from which subscribers apply it as they would a publisher's.

    "started": there was no open batch, so one was made for every shard.  "waiting": some shard hasn't
    uploaded it.  "reverted": the shards' columns disagree, so all capture it again.  "merged": change
    sets, manifest and the master's schema changes are those of one database, and the next batch is open.

    What is to be done with a batch that all shards have uploaded is decided once and written first, so
    a run that fails on the way is carried on with the same outcome for all shards."""
    ledger = store.read_ledger(spark, root, "publisher")
    last = None if ledger is None else ledger.where(F.col("feed") == feed).orderBy(F.desc("ctid")).first()
    names = [name for name, _ in shards]
    if last is None or last["sync_bitwise"] & UPLOAD:
        newest = _shard_ledgers(spark, shards, feed).agg(F.max("ctid")).first()[0] or 0
        _next_shard_batches(spark, shards, root, feed, (newest if last is None else last["ctid"]) + 1)
        return "started"
    ctid = last["ctid"]
    folder = f"{root}/decisions/feed={feed or '-'}/ctid={ctid}"
    made = sorted(n for n in children(spark, folder) if n.endswith(".json"))
    undone = [n for n in made if read_text(spark, f"{folder}/{n}.done") is None]
    if undone:
        outcome, place = json.loads(read_text(spark, f"{folder}/{undone[0]}"))["outcome"], f"{folder}/{undone[0]}"
    else:
        state = shards_ready(_shard_ledgers(spark, shards, feed).where(F.col("ctid") == ctid)).first()
        if state is None or not state["ready"] or state["shards"] < len(shards):
            return "waiting"
        wrong = [r["table_name"] for r in schemas_out_of_sync(_change_columns(spark, specs, shards, ctid)).collect()]
        outcome, place = "revert" if wrong else "merge", f"{folder}/{len(made):06d}.json"
        if not write_new(spark, place, json.dumps({"outcome": outcome, "tables": wrong})):
            outcome = json.loads(read_text(spark, place))["outcome"]
    if outcome == "revert":
        back = revert(_shard_ledgers(spark, shards, feed).where(F.col("ctid") == ctid), spark.createDataFrame([(ctid,)], "ctid long"))
        rows = {r["shard"]: r.asDict(recursive=True) for r in back.collect()}
        for name, shard in shards:
            store.record_rows(spark, shard, "publisher", [{k: v for k, v in rows[name].items() if k != "shard"}], LEDGER)
        write_text(spark, f"{place}.done", outcome)
        return "reverted"
    p = Progress(spark, root, "publisher", feed, [ctid])
    with p.step("MergeShards"):
        merge_batch(spark, specs, shards, root, ctid)
    with p.step("MergeManifests"):
        _merge_manifests(spark, specs, shards, names, root, ctid)
    changes = f"schema_changes/ctid={ctid}"
    if store.exists(spark, f"{shards[0][1]}/{changes}"):
        spark.read.parquet(f"{shards[0][1]}/{changes}").coalesce(1).write.mode("overwrite").parquet(f"{root}/{changes}")
    p.set(CAPTURE, PUBLISH_SCHEMA, UPLOAD, done=True)
    _next_shard_batches(spark, shards, root, feed, ctid + 1)
    write_text(spark, f"{place}.done", outcome)
    return "merged"


def _merge_manifests(spark: SparkSession, specs: list[TableSpec], shards: list[tuple[str, str]], names: list[str], root: str, ctid: int) -> None:
    """Counts of the merged change sets; tables without one as their first shard has them."""
    sets = [(s, df) for s in specs if (df := store.read_change_set(spark, root, s.name, ctid)) is not None]
    parts = [df.select(F.lit(s.schema).alias("schema_name"), F.lit(s.name).alias("table_name"), OP) for s, df in sets]
    empty = spark.createDataFrame([], f"schema_name string, table_name string, {OP} string")
    own = build_manifest(union_all([empty, *parts]), spec_table(spark, [s for s, _ in sets]))
    places = [(name, f"{place}/manifest/ctid={ctid}") for name, place in shards]
    told = [spark.read.parquet(path).withColumn("shard", F.lit(name)) for name, path in places if store.exists(spark, path)]
    if told:
        rest = merge_manifests(union_all(told), names).drop("shard")
        key = lambda df: F.lower(F.concat_ws(".", df["schema_name"], df["table_name"]))
        own = own.unionByName(rest.join(own, key(rest) == key(own), "left_anti").select(*own.columns))
    own.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/ctid={ctid}")


def retire(spark: SparkSession, root: str, cut, ledger: str = "publisher", record_cut=None) -> list[str]:
    """Delete the change sets of batches older than ``cut`` and target files no longer in force.

    With ``record_cut``, which is no later than ``cut``, rows of the ledger and of the error log older than
    that go too; the last batch of a feed stays in the ledger, as the next one goes on from it."""
    rows = store.read_ledger(spark, root, ledger)
    gone = []
    if rows is not None:
        late = expired_ctids(rows, F.lit(cut), "publisher") if ledger == "publisher" else expired_ctids(rows.withColumn("subscriber", F.col("feed")), F.lit(cut), "subscriber")
        if record_cut is not None:
            now = F.current_timestamp()
            check_retention(*spark.range(1).select(F.datediff(now, F.lit(cut)), F.datediff(now, F.lit(record_cut))).first())
        gone = store.delete_change_sets(spark, root, late)
        if record_cut is not None:
            at = F.coalesce("sync_stop_time", "sync_start_time") if ledger == "subscriber" else F.col("sync_start_time")
            newest = F.max("ctid").over(Window.partitionBy("feed"))
            store.trim_ledger(spark, root, ledger, (at < F.lit(record_cut)) & (F.col("ctid") < newest))
    if record_cut is not None and store.exists(spark, f"{root}/errors"):
        kept = trim_log(spark.read.parquet(f"{root}/errors"), F.lit(record_cut), "log_date")
        kept = spark.createDataFrame(kept.collect(), kept.schema)  # messages of the days that are kept
        kept.coalesce(1).write.mode("overwrite").parquet(f"{root}/errors")
    return gone + store.vacuum(spark, root)
