"""What may be forgotten: expired batches, old ledger and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import integer_suffix


def expired_ctids(ledger: DataFrame, cut: Column, scope: str, hold_open: bool = False) -> DataFrame:
    """(feed, ctid) that are older than ``cut``.

    publisher: by start time; version: the same batches, named by their stop version, as the change sets
    of sources that number them by version are.  relay: by the last stop over all subscribers; one that hasn't
    finished doesn't hold a batch back unless ``hold_open``.  subscriber: (feed, subscriber, ctid) by
    its own stop; unfinished ones never expire.
    """
    if scope == "publisher":
        return ledger.where(F.col("sync_start_time") < cut).select("feed", "ctid")
    if scope == "version":
        return ledger.where((F.col("sync_start_time") < cut) & F.col("sync_stop_version").isNotNull()).select("feed", F.col("sync_stop_version").alias("ctid"))
    if scope == "subscriber":
        return ledger.where(F.col("sync_stop_time") < cut).select("feed", "subscriber", "ctid")
    if scope != "relay":
        raise ValueError(f"unknown scope {scope}")
    got = ledger.groupBy("feed", "ctid").agg(F.max("sync_stop_time").alias("stop"), F.count_if(F.col("sync_stop_time").isNull()).alias("open"))
    return got.where((F.col("stop") < cut) & (F.lit(not hold_open) | (F.col("open") == 0))).select("feed", "ctid")


def drop_expired(names: DataFrame, expired: DataFrame, ending: str = "") -> DataFrame:
    """The names (column ``name``, and ``feed`` where several are kept together) whose number after the
    last underscore is an expired ctid.  ``ending``: what follows the number, as in staged files."""
    on = [c for c in ("feed", "ctid") if c == "ctid" or c in names.columns]
    own = names.where(F.endswith("name", F.lit(ending))) if ending else names
    stem = F.substring("name", F.lit(1), F.length("name") - len(ending))
    return own.withColumn("ctid", integer_suffix(stem)).join(expired.select(*on).distinct(), on, "left_semi").select(*on[:-1], "name", "ctid")


def trim_ledger(ledger: DataFrame, cut: Column, scope: str = "publisher") -> DataFrame:
    """Rows kept: by start time, or for subscribers by the stop time, else the start."""
    at = F.coalesce("sync_stop_time", "sync_start_time") if scope == "subscriber" else F.col("sync_start_time")
    return ledger.where(at >= cut)


def check_retention(data_days: int, record_days: int) -> None:
    if record_days < data_days:
        raise ValueError("ledger rows must be kept at least as long as change sets")


def trim_log(log: DataFrame, cut: Column, column: str = "ts") -> DataFrame:
    return log.where(F.col(column) >= cut)
