"""Continuous apply: change rows as a stream, merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import COMPLETE
from tidemark.operators.apply import merged, newer_only
from tidemark.operators.changes import dedupe_changes
from tidemark.sources import pointers, store
from tidemark.spec import META, OP, VERSION, TableSpec


def merge_versioned(target: DataFrame, changes: DataFrame, spec: TableSpec, forget: int | None = None) -> DataFrame:
    """Merge into a target that keeps, in ``_version`` and ``_deleted``, the last version of each key
    and whether it is gone: late and repeated changes are ignored, deleted keys remembered, those up to
    version ``forget`` no longer.

    ``__action`` says what became of the live row: BURY is a delete of one, which leaves its key behind,
    MARK a delete of a row that isn't there."""
    fresh = newer_only(target, dedupe_changes(changes, spec.pk), spec)
    sent = fresh.withColumns({"__seen": F.col(VERSION), "_deleted": F.col(OP) == "D"}).drop(VERSION)
    sent = sent.withColumn(OP, F.when((F.col(OP) == "D"), "U").otherwise(F.col(OP)))
    was = target.withColumn("__was", F.col("_deleted")).withColumnRenamed(VERSION, "__seen")
    out = merged(was, sent, spec)
    gone, before = F.col("_deleted"), F.coalesce("__was", F.lit(True))
    old = F.lit(False) if forget is None else gone & (F.col("__seen") <= forget)
    action = (
        F.when((F.col("__action") == "KEEP") & old, "FORGET").when(F.col("__action") == "KEEP", "KEEP")
        .when(gone & ~before, "BURY").when(gone, "MARK").when(before, "INSERT").otherwise(F.col("__action"))
    )
    out = out.withColumn("__action", action).withColumnRenamed("__seen", VERSION)
    return out.select(*target.columns, "__action")


def apply_versioned(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    return merge_versioned(target, changes, spec).drop("__action")


def live(target: DataFrame) -> DataFrame:
    """The rows of a versioned target that are not deleted."""
    return target.where(~F.col("_deleted")).drop("_deleted", *META)


#: Micro-batches after which parts full of deleted keys that may be forgotten are written anew.
PURGE = 16


def stream_apply(
    changes: DataFrame, root: str, spec: TableSpec, checkpoint: str, trigger: dict | None = None, buckets: int = 16, delay: int | None = None, purge: int = PURGE,
    first_batch: int = 0,
) -> StreamingQuery:
    """Apply a stream of change rows to the versioned target under ``root``.

    Each micro-batch is reduced to one row per key and merged into the parts it touches (a new target
    gets ``buckets`` of them); then it goes to the history under its batch id, and a ledger row says
    what was done.  What a batch did is noted in its commit, so one that is run again after it came into
    force changes nothing, replaces its own history and records the same row.  Subscribers are independent:
    each has its own root and checkpoint.

    A stream that is begun anew with another checkpoint goes on counting from ``first_batch``.

    With ``delay``, deleted keys are forgotten once the watermark has passed them, which is the greatest
    version of earlier batches less ``delay``.  Rows at or below it come too late: they are kept aside
    (``read_late``) and counted, since it is no longer known whether their keys were deleted.
    """
    note = f"stream/{spec.name.lower()}"

    def one(batch: DataFrame, batch_id: int) -> None:
        batch_id += first_batch
        spark = batch.sparkSession
        began = F.lit(spark.sql("select current_timestamp()").first()[0])
        if store.target(spark, root, spec.name) is None:
            cols = [c for c in batch.columns if c not in META]
            empty = spark.createDataFrame([], batch.select(*cols, VERSION, F.lit(False).alias("_deleted")).schema)
            store.commit(spark, root, {spec.name: store.Target(empty.schema, buckets, {})})
        noted = pointers.snapshot(spark, root).notes.get(note)
        again = noted is not None and noted[0] == batch_id
        mark = None if noted is None else noted[1] if again else noted[2]  # the watermark that the batch begins with
        staged = f"{root}/staging/table={spec.name.lower()}"  # a micro-batch is read once
        if delay is None:
            dedupe_changes(batch, spec.pk).write.mode("overwrite").parquet(staged)
        else:
            timely = F.lit(True) if mark is None else F.col(VERSION) > mark
            raw = f"{root}/staging/raw={spec.name.lower()}"
            batch.write.mode("overwrite").parquet(raw)
            rows = spark.read.schema(batch.schema).parquet(raw)
            rows.where(~timely).write.mode("overwrite").parquet(f"{root}/late/table={spec.name.lower()}/batch={batch_id}")
            dedupe_changes(rows.where(timely), spec.pk).write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        span = rows.agg(F.count(F.lit(1)).alias("n"), F.min(VERSION).alias("low"), F.max(VERSION).alias("high")).first()
        late = 0 if delay is None else spark.read.schema(batch.schema).parquet(f"{root}/late/table={spec.name.lower()}/batch={batch_id}").count()
        if not span["n"] and not late:
            return
        if not again:
            ahead = mark if delay is None or span["high"] is None else max(span["high"] - delay, span["high"] - delay if mark is None else mark)
            merge = partial(merge_versioned, forget=mark if delay is not None else None)
            notes = lambda did: {note: [batch_id, mark, ahead, did[0].inserted, did[0].deleted]}
            store.apply_group(spark, root, [(spec, rows)], notes, merge)
            if delay is not None and ahead is not None and batch_id % purge == purge - 1:
                store.purge(spark, root, spec, F.col("_deleted") & (F.col(VERSION) <= ahead))
            noted = pointers.snapshot(spark, root).notes[note]
        if spec.history:
            store.append_history(rows, batch_id, root, spec.name)
        done = (spec.name.lower(), batch_id, span["low"], span["high"], COMPLETE, span["n"], noted[3], noted[4], late)
        kinds = "feed string, ctid long, sync_start_version long, sync_stop_version long, sync_bitwise int, rows long, inserted long, deleted long, late long"
        line = spark.createDataFrame([done], kinds).withColumns({"sync_start_time": began, "sync_stop_time": F.current_timestamp()})
        store.record(spark, root, "stream", line)

    w = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_late(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """Rows that came after their watermark, with the ``batch`` they came in."""
    return spark.read.parquet(f"{root}/late/table={spec.name.lower()}")


def consume(changes: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand each micro-batch of change rows to ``fn``, without a target table."""
    return changes.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
