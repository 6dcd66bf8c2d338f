"""Several change sets of a table made one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.apply import union_all
from tidemark.operators.changes import dedupe_changes
from tidemark.spec import VERSION


def consolidate(batches: list[tuple[int, DataFrame]], pk: tuple[str, ...]) -> DataFrame:
    """One row per key from batches (ctid, change set): the newest batch's columns, matched by name
    without case and null where an old batch lacks them; of each key the highest version, then the
    highest ctid."""
    if not batches:
        raise ValueError("nothing to consolidate")
    ordered = sorted(batches, key=lambda b: b[0], reverse=True)
    wanted = ordered[0][1].columns
    parts = []
    for ctid, df in ordered:
        have = {c.lower(): c for c in df.columns}
        parts.append(df.select(*[F.col(have[c.lower()]).alias(c) for c in wanted if c.lower() in have], F.lit(ctid).cast("long").alias("__ctid")))
    return dedupe_changes(union_all(parts).select(*wanted, "__ctid"), pk, (VERSION, "__ctid")).drop("__ctid")


def tables_with_changes(manifests: DataFrame) -> DataFrame:
    """(ctid, schema_name, table_name, expected_rows) of tables that have any rows."""
    return manifests.where(F.col("expected_rows") > 0).select("ctid", "schema_name", "table_name", "expected_rows")


def latest_change_sets(manifests: DataFrame) -> DataFrame:
    """Per table the last ctid that has rows, and how many batches have any."""
    got = manifests.where(F.col("expected_rows") > 0).groupBy("schema_name", "table_name")
    return got.agg(F.max("ctid").alias("ctid"), F.max_by("expected_rows", "ctid").alias("expected_rows"), F.count(F.lit(1)).alias("batches"))


def batch_numbers(log: DataFrame, batches: int) -> DataFrame:
    """A log cut into ``batches`` equal ranges of versions, numbered from 1 as ctid."""
    top = log.agg((F.max("version") + 1).alias("__top"))
    return log.join(F.broadcast(top)).withColumn("ctid", F.expr(f"1 + version * {batches} div __top")).drop("__top")  # one row
