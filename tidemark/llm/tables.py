"""Reading the corpus tables and the checkpoint folder that the session names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.paths import delete, scratch


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows to Python workers ``rows`` at a time: texts are wide, and every task buffers batches
    on both sides.  A setting other than Spark's default stays."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut there, so the
    loss of executors repeats no work before it.  ``discard`` deletes a table that nothing reads any
    more; those that a result is still read from stay until the folder is cleaned."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables."""
    for df in tables:
        for path in {m[1] for f in df.inputFiles()[:1] if (m := re.match(r"(.*/tidemark-table-[0-9a-f]{32})/", f))}:
            delete(df.sparkSession, path)


#: Keys that a join may broadcast.
FEW = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """Keys that ``written`` wrote, for one side of a join: broadcast if there are at most ``FEW``."""
    return F.broadcast(keys) if keys.count() <= FEW else keys
