"""Change sets, manifests and ledgers of several shards made those of one logical database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import UPLOAD, has_bit
from tidemark.operators.apply import union_all
from tidemark.operators.changes import lone
from tidemark.spec import OP


def ordinal(shard: Column, order: list[str]) -> Column:
    """Place of a shard in the configured order; unknown shards come last."""
    out = F.lit(len(order))
    for n, name in enumerate(order):
        out = F.when(shard == name, F.lit(n)).otherwise(out)
    return out


def merge_shard_rows(rows: DataFrame, pk: tuple[str, ...], order: list[str]) -> DataFrame:
    """Of each key the first row in shard order, except that an I or U of any shard beats a D.  Rows
    with a null in the key match no others, so all of them stay."""
    w = Window.partitionBy(*pk, "__lone").orderBy((F.col(OP) == "D").cast("int"), ordinal(F.col("shard"), order), "shard")
    return rows.withColumn("__lone", lone(pk)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__lone")


def merge_shards(shards: list[tuple[str, DataFrame]], pk: tuple[str, ...], order: list[str]) -> DataFrame:
    return merge_shard_rows(union_all([df.withColumn("shard", F.lit(name)) for name, df in shards]), pk, order).drop("shard")


def merge_manifests(manifests: DataFrame, order: list[str]) -> DataFrame:
    """Manifest rows (shard, schema_name, table_name, ...): of each table those of its first shard."""
    w = Window.partitionBy(F.lower("schema_name"), F.lower("table_name")).orderBy(ordinal(F.col("shard"), order), "shard")
    return manifests.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def schemas_out_of_sync(columns: DataFrame) -> DataFrame:
    """Tables whose shards disagree on (column, key, type), whatever the order and nullability.

    ``columns``: (shard, table_name, column_name, is_pk, data_type).  Shards without the table don't
    count.
    """
    shape = columns.groupBy("table_name", "shard").agg(F.sort_array(F.collect_list(F.struct(F.lower("column_name").alias("c"), "is_pk", F.lower("data_type").alias("t")))).alias("shape"))
    return shape.groupBy("table_name").agg(F.count_distinct("shape").alias("shapes")).where("shapes > 1")


def shard_schema_changes(changes: DataFrame, master: str) -> DataFrame:
    """Schema changes are taken from the master shard alone."""
    return changes.where(F.col("shard") == master).drop("shard")


def shards_ready(ledgers: DataFrame) -> DataFrame:
    """Per ctid: whether every shard has uploaded it."""
    return ledgers.groupBy("ctid").agg(F.bool_and(has_bit(F.col("sync_bitwise"), UPLOAD)).alias("ready"), F.count(F.lit(1)).alias("shards"))


def revert(ledgers: DataFrame, ctids: DataFrame) -> DataFrame:
    """All shards' progress of these ctids set back to nothing."""
    hit = ctids.select("ctid").distinct().withColumn("__hit", F.lit(True))
    out = ledgers.join(hit, "ctid", "left")
    return out.withColumn("sync_bitwise", F.when(F.col("__hit"), 0).otherwise(F.col("sync_bitwise"))).select(*ledgers.columns)


def next_shard_versions(ledgers: DataFrame) -> DataFrame:
    """The next sharded batch: one new ctid for all, each shard starting at its own last stop."""
    last = ledgers.groupBy("shard").agg(F.max("ctid").alias("last"), F.max_by("sync_stop_version", "ctid").alias("sync_start_version"))
    new = ledgers.agg((F.max("ctid") + 1).alias("ctid"))
    return last.join(F.broadcast(new)).select("shard", "ctid", "sync_start_version")  # one row
