"""The error log, its digest, and step metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_errors(messages: DataFrame, agent: str, server: str, database: str) -> DataFrame:
    """Rows for the error log from (id, level, message, log_date); only errors are logged."""
    head = F.lit(f"agent: {agent}; server: {server}; database: {database}")
    return messages.where(F.lower("level") == "error").select("id", head.alias("headers"), "message", "log_date", F.lit(False).alias("sent"))


def shown(message: Column) -> Column:
    """A message as shown: of one that starts with ``Table:`` and has over two lines, the first two."""
    lines = F.split(message, "\n")
    return F.when(F.startswith(message, F.lit("Table:")) & (F.size(lines) > 2), F.array_join(F.slice(lines, 1, 2), "\n")).otherwise(message)


def error_digest(errors: DataFrame) -> DataFrame:
    """Unsent errors counted by day and message, with the time of the newest."""
    unsent = errors.where(~F.col("sent")).select(F.to_date("log_date").alias("day"), shown(F.col("message")).alias("message"), "log_date")
    return unsent.groupBy("day", "message").agg(F.count(F.lit(1)).alias("n"), F.max("log_date").alias("newest"))


def digest_text(digest: DataFrame) -> DataFrame:
    """The digest as one text block per row, newest first."""
    line = F.concat_ws("\n", F.concat(F.col("day").cast("string"), F.lit(" x "), F.col("n").cast("string")), F.col("message"))
    return digest.select("newest", line.alias("block")).orderBy(F.desc("newest"), "block")


def mark_sent(errors: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return errors.join(hit, "id", "left").withColumn("sent", F.col("sent") | F.coalesce("__hit", F.lit(False))).drop("__hit").select(*errors.columns)


def step_metrics(published: DataFrame, applied: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per feed, subscriber and batch: versions applied, minutes from capture to apply and, with
    ``counts`` (feed, subscriber, ctid, rows), the rows."""
    p = published.select("feed", "ctid", F.col("sync_start_time").alias("captured"), (F.col("sync_stop_version") - F.col("sync_start_version")).alias("versions"))
    a = applied.where("sync_stop_time is not null").select("feed", "subscriber", "ctid", F.col("sync_stop_time").alias("done"))
    out = p.join(a, ["feed", "ctid"]).select("feed", "subscriber", "ctid", "versions", F.timestamp_diff("MINUTE", "captured", "done").alias("lag_minutes"))
    if counts is None:
        return out
    key = ["feed", "subscriber", "ctid"]
    return out.join(counts.groupBy(*key).agg(F.sum("rows").alias("rows")), key, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def step_durations(steps: DataFrame) -> DataFrame:
    """Per batch and step (feed, ctid, step, began, ended, rows): how often it ran, milliseconds in all,
    and the rows of its last run."""
    at = lambda c: F.col(c).cast("timestamp")
    took = F.unix_millis(at("ended")) - F.unix_millis(at("began"))
    return steps.groupBy("feed", "ctid", "step").agg(F.count(F.lit(1)).alias("runs"), F.sum(took).alias("millis"), F.max_by("rows", F.unix_micros(at("began"))).alias("rows"))
