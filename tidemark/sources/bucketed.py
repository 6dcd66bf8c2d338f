"""Change sets kept in buckets of their key, so that several are made one without a shuffle.

A table's change sets are one bucketed Spark table over the store's folder, with a partition a ctid.
Spark takes the same bucket of all partitions in one task, where rows of a key lie together, so the newest
row of each key is found without an exchange.  The number of buckets is fixed when the first change set is
written and kept beside them; a session that hasn't seen the table declares it anew over the same folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import dedupe_changes
from tidemark.sources.paths import children, read_text, write_new
from tidemark.spec import VERSION

#: Rows that a bucket of a change set is laid out for.
ROWS = 1_000_000


def _home(root: str, table: str) -> str:
    return f"{root}/bucketed/table={table.lower()}"


def _declared(spark: SparkSession, root: str, table: str, columns: str, pk: tuple[str, ...], buckets: int) -> str:
    """The name, in this session, of the table over the folder with these columns."""
    home = _home(root, table)
    name = "tidemark_" + hashlib.md5(f"{home} {columns} {pk} {buckets}".encode()).hexdigest()
    keys = ", ".join(f"`{c}`" for c in pk)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, ctid BIGINT) USING parquet PARTITIONED BY (ctid) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{home}/rows'")
    return name


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_bucketed(df: DataFrame, root: str, table: str, ctid: int, pk: tuple[str, ...], buckets: int | None = None) -> None:
    """The change set of a table and ctid, replacing an earlier attempt; one file a bucket."""
    spark, home = df.sparkSession, _home(root, table)
    told = read_text(spark, f"{home}/buckets")
    if told is None:
        n = buckets or 1 << max(0, -(-df.count() // ROWS) - 1).bit_length()
        write_new(spark, f"{home}/buckets", str(n))
        told = read_text(spark, f"{home}/buckets")
    n = int(told)
    name = _declared(spark, root, table, _columns(df), pk, n)
    key = [F.col(f"`{c}`") for c in pk]
    view = f"{name}_{ctid}"
    df.repartition(n, *key).sortWithinPartitions(*key).createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (ctid = {ctid}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def read_bucketed(spark: SparkSession, root: str, table: str, ctids: list[int], like: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """The rows of some ctids in the columns of ``like``, null where an old change set lacks one, with
    ``ctid``; rows of one key are in one partition."""
    told = read_text(spark, f"{_home(root, table)}/buckets")
    if told is None:
        raise ValueError(f"{table}: no change set has been written in buckets")
    name = _declared(spark, root, table, _columns(like), pk, int(told))
    there = {n for n in children(spark, f"{_home(root, table)}/rows") if n.startswith("ctid=")}
    for c in ctids:
        if f"ctid={c}" in there:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (ctid = {c})")
    return spark.table(name).where(F.col("ctid").isin(list(ctids)))


def consolidate_bucketed(spark: SparkSession, root: str, table: str, ctids: list[int], like: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """One row a key from change sets written in buckets, as ``consolidate`` gives it, without an
    exchange.  ``like``: the newest change set's columns."""
    rows = read_bucketed(spark, root, table, ctids, like, pk)
    return dedupe_changes(rows, pk, (VERSION, "ctid")).drop("ctid")
