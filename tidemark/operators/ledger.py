"""Batch control as operations on ledgers: every feed and table is planned by one job.

A publisher's ledger has (feed, ctid, sync_start_version, sync_stop_version, sync_start_time,
sync_stop_time, sync_bitwise); a subscriber's has ``subscriber`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import CAPTURE, COMPLETE, UPLOAD, has_bit, time_of_day, with_bit


def last_start_time(ledger: DataFrame, before: Column, bit: int, default: Column, keys: tuple[str, ...] = ("feed",)) -> DataFrame:
    """Per feed, the start of the last batch below ``before`` that has the bit; else the default."""
    hit = (F.col("ctid") < before) & has_bit(F.col("sync_bitwise"), bit)
    return ledger.groupBy(*keys).agg(F.coalesce(F.max(F.when(hit, F.col("sync_start_time"))), default).alias("last_start_time"))


def last_batch(ledger: DataFrame, keys: tuple[str, ...] = ("feed",)) -> DataFrame:
    """The row with the highest ctid of each feed (or feed and subscriber)."""
    rest = [c for c in ledger.columns if c not in keys]
    row = F.max(F.struct("ctid", *[c for c in rest if c != "ctid"])).alias("x")
    return ledger.groupBy(*keys).agg(row).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def pending_batches(published: DataFrame, last: DataFrame, bit: int = UPLOAD) -> DataFrame:
    """Published batches beyond each subscriber's last ctid: ``last`` has (feed, subscriber, ctid)."""
    seen = last.select("feed", "subscriber", F.col("ctid").alias("__last"))
    out = published.join(seen, "feed").where((F.col("ctid") > F.col("__last")) & has_bit(F.col("sync_bitwise"), bit))
    return out.drop("__last")


def incomplete_batches(ledger: DataFrame) -> DataFrame:
    """A subscriber's batches above its last complete one; none if it never completed any."""
    done = ledger.where(F.col("sync_bitwise") == COMPLETE).groupBy("feed", "subscriber").agg(F.max("ctid").alias("__done"))
    return ledger.join(done, ["feed", "subscriber"]).where(F.col("ctid") > F.col("__done")).drop("__done")


def plan_batch(ledger: DataFrame, versions: DataFrame, sharded: bool = False) -> DataFrame:
    """The batch each feed should work on, from its last one and ``versions`` (feed, current_version).

    Uploaded: a new batch from its stop to the current version (none where shards are coordinated).
    Failed before capture: the same, up to the current version.  Captured: resumed as it is.  A feed
    without a ledger has no plan and an error text.
    """
    last = last_batch(ledger)
    out = versions.join(last, "feed", "left")
    bits = F.col("sync_bitwise")
    up, taken, none = has_bit(bits, UPLOAD), has_bit(bits, CAPTURE), F.col("ctid").isNull()
    plan = F.when(none, F.lit(None).cast("string")).when(up, "wait" if sharded else "new").when(taken, "resume").otherwise("retry")
    new, kept = F.col("plan") == "new", F.col("plan").isin("resume", "wait")
    return out.withColumn("plan", plan).select(
        "feed",
        F.when(new, F.col("ctid") + 1).otherwise(F.col("ctid")).alias("ctid"),
        F.when(new, F.col("sync_stop_version")).otherwise(F.col("sync_start_version")).alias("sync_start_version"),
        F.when(kept, F.col("sync_stop_version")).when(~none, F.col("current_version")).alias("sync_stop_version"),
        F.when(new, 0).otherwise(bits).alias("sync_bitwise"),
        "plan",
        F.when(none, F.lit("the ledger has no batch of this feed")).alias("error"),
    )


def resize_batches(batches: DataFrame, most: int, now: Column, begin: str | None = None, end: str | None = None, current: str = "sync_stop_version") -> DataFrame:
    """Batches of more than ``most`` versions cut to that many, except inside the daily window from
    ``begin`` (excluded) to ``end`` (included), which may wrap midnight; there such batches run to
    ``current``.  Smaller batches stay as they are, and so does everything if ``most`` is 0."""
    start, stop, t = F.col("sync_start_version"), F.col("sync_stop_version"), time_of_day(now)
    inside = F.lit(False)
    if begin is not None and end is not None:
        after, upto = t > F.lit(begin), t <= F.lit(end)
        inside = (after & upto) if begin < end else (after | upto)
    large = F.lit(most > 0) & ((stop - start) > most)
    return batches.withColumn("sync_stop_version", F.when(large & inside, F.col(current)).when(large, start + most).otherwise(stop))


def table_start_versions(batches: DataFrame, tables: DataFrame, registry: DataFrame) -> DataFrame:
    """Start version of every table (feed, table_name, min_valid_version): the batch's, or the least
    valid one where that is 0; overridden by the registry (feed, table_name, next_version,
    in_progress); tables being initialised are left out."""
    out = tables.join(batches.select("feed", "ctid", "sync_start_version"), "feed").join(registry, ["feed", "table_name"], "left")
    out = out.where(~F.coalesce("in_progress", F.lit(False)))
    start = F.when(F.col("sync_start_version") == 0, F.col("min_valid_version")).otherwise(F.col("sync_start_version"))
    return out.select("feed", "ctid", "table_name", "min_valid_version", F.coalesce("next_version", start).alias("start_version"))


def validate_sources(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """``tables`` (feed, table_name, start_version) with the reason why one can't be captured: the
    ``catalog`` (feed, table_name, tracked, min_valid_version) lacks it, it isn't tracked, or its
    log no longer reaches back to the start."""
    out = tables.drop("min_valid_version").join(catalog.withColumn("__there", F.lit(True)), ["feed", "table_name"], "left")
    reason = (
        F.when(F.col("__there").isNull(), "table does not exist")
        .when(~F.coalesce("tracked", F.lit(False)), "changes are not tracked")
        .when(F.col("start_version") < F.col("min_valid_version"), "start version is no longer valid")
    )
    return out.select("feed", "table_name", "start_version", reason.alias("reason"))


def set_bit(ledger: DataFrame, hit: Column, bit: int) -> DataFrame:
    """The bit added where ``hit`` holds; setting it twice changes nothing."""
    return ledger.withColumn("sync_bitwise", F.when(hit, with_bit(F.col("sync_bitwise"), bit)).otherwise(F.col("sync_bitwise")))


def mark_complete(ledger: DataFrame, hit: Column, now: Column) -> DataFrame:
    return ledger.withColumns({"sync_bitwise": F.when(hit, COMPLETE).otherwise(F.col("sync_bitwise")), "sync_stop_time": F.when(hit, now).otherwise(F.col("sync_stop_time"))})


def plan_subscriber(published: DataFrame, ledger: DataFrame, threshold: int) -> DataFrame:
    """Batches each subscriber should apply, with the mode: incomplete ones first, else what is newly
    published; below ``threshold`` batches one by one, else merged.  Where the ledger keeps the mode
    (column ``mode``), batches that are resumed keep theirs, whatever the threshold is by now."""
    cols = ["feed", "subscriber", "ctid", "sync_start_version", "sync_stop_version", "sync_bitwise"]
    kept = F.col("mode") if "mode" in ledger.columns else F.lit(None).cast("string")
    open_ = incomplete_batches(ledger).select(*cols, F.lit("resume").alias("why"), kept.alias("__kept"))
    last = ledger.groupBy("feed", "subscriber").agg(F.max("ctid").alias("ctid"))
    idle = last.join(open_.select("feed", "subscriber").distinct(), ["feed", "subscriber"], "left_anti")
    new = pending_batches(published, idle).withColumn("sync_bitwise", F.lit(0)).select(*cols, F.lit("new").alias("why"))
    todo = open_.unionByName(new, allowMissingColumns=True)
    count = todo.groupBy("feed", "subscriber").agg(F.count(F.lit(1)).alias("__n"), F.max("__kept").alias("__mode"))
    mode = F.coalesce("__mode", F.when(F.col("__n") < threshold, "single").otherwise("merged"))
    return todo.drop("__kept").join(count, ["feed", "subscriber"]).withColumn("mode", mode).drop("__n", "__mode")


def is_full_run_time(last: Column, now: Column, hours: Column) -> Column:
    """Whether some hour of ``hours`` (times of day as 'HH:mm:ss') has passed today since the last run;
    a last run on an earlier date always counts as before it.  Time running backwards is an error."""
    t, before = time_of_day(now), time_of_day(last)
    earlier = F.to_date(last) < F.to_date(now)
    due = F.exists(hours, lambda h: (h < t) & (earlier | (before < h)))
    return F.when(now < last, F.raise_error(F.lit("the last run lies in the future")).cast("boolean")).otherwise(due)


def register_init(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Tables (feed, table_name, next_version, started) put in progress, replacing earlier entries."""
    rows = new.select("feed", "table_name", "next_version", F.lit(True).alias("in_progress"), "started", F.lit(None).cast("timestamp").alias("finished"))
    return registry.join(new.select("feed", "table_name"), ["feed", "table_name"], "left_anti").unionByName(rows)


def finish_init(registry: DataFrame, hit: Column, now: Column) -> DataFrame:
    return registry.withColumns({"in_progress": F.when(hit, False).otherwise(F.col("in_progress")), "finished": F.when(hit, now).otherwise(F.col("finished"))})


def cleanup_init(registry: DataFrame, batches: DataFrame) -> DataFrame:
    """Entries dropped that were finished before the start of their feed's batch (sync_start_time)."""
    out = registry.join(batches.select("feed", "sync_start_time"), "feed", "left")
    old = ~F.col("in_progress") & (F.col("finished") < F.col("sync_start_time"))
    return out.where(~F.coalesce(old, F.lit(False))).drop("sync_start_time")
