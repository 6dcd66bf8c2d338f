"""Manifests of published change sets, and audits against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import split_keys
from tidemark.spec import OP, TableSpec


def spec_table(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    rows = [(s.schema, s.name, list(s.pk), None if s.columns is None else list(s.columns)) for s in specs]
    return spark.createDataFrame(rows, "schema_name string, table_name string, pk array<string>, columns array<string>")


NAMES = ["__schema", "__table"]


def _named(df: DataFrame) -> DataFrame:
    """With the names by which tables are matched: schema (``dbo`` where there is none) and table,
    without case."""
    schema = F.lower("schema_name") if "schema_name" in df.columns else F.lit("dbo")
    return df.withColumns({"__schema": F.coalesce(schema, F.lit("dbo")), "__table": F.lower("table_name")})


def build_manifest(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table (schema_name, table_name, pk): rows of its change set, and those that insert or
    update; a table without changes has a row too.  ``changes`` has table_name, the operation and, for
    schemas other than ``dbo``, schema_name; case doesn't matter."""
    got = _named(changes).groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(OP).isin("I", "U")).alias("i"))
    out = _named(tables).join(got, NAMES, "left")
    return out.select("schema_name", "table_name", "pk", F.coalesce("n", F.lit(0)).alias("expected_rows"), F.coalesce("i", F.lit(0)).alias("insert_count"))


def row_counts(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of each table's change set, 0 where there is none; tables are matched as in a manifest."""
    got = _named(changes).groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n"))
    return _named(tables).join(got, NAMES, "left").select(*[c for c in ("schema_name", "table_name") if c in tables.columns], F.coalesce("n", F.lit(0)).alias("rows"))


def total_captured(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def total_applied(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Applied counts (inserted, deleted) summed over tables and their archives, per ``keys``."""
    zero = F.lit(0).cast("long")
    return counts.groupBy(*keys).agg(F.coalesce(F.sum("inserted"), zero).alias("inserted"), F.coalesce(F.sum("deleted"), zero).alias("deleted"))


def audit_counts(manifests: DataFrame, applied: DataFrame) -> DataFrame:
    """Expected inserts (summed over batches) against applied ones per table, with the missing
    percentage truncated toward zero.  Nothing expected and nothing applied is 0; something applied
    where nothing was expected is an error and has no percentage."""
    name = lambda df: F.min("schema_name") if "schema_name" in df.columns else F.lit("dbo")
    expected = _named(manifests).groupBy(*NAMES).agg(F.sum("insert_count").alias("expected"), name(manifests).alias("s"), F.min("table_name").alias("t"))
    got = _named(applied).groupBy(*NAMES).agg(F.sum("inserted").alias("inserted"), name(applied).alias("s2"), F.min("table_name").alias("t2"))
    out = expected.join(got, NAMES, "full_outer")
    out = out.select(
        F.coalesce("s", "s2").alias("schema_name"), F.coalesce("t", "t2").alias("table_name"),
        F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("inserted", F.lit(0)).cast("long").alias("inserted"),
    )
    percent = F.when(F.col("expected") > 0, F.expr("(expected - inserted) * 100 div expected")).when(F.col("inserted") == 0, 0)
    return out.withColumns({"percent": percent, "error": (F.col("expected") == 0) & (F.col("inserted") > 0)})


def resolve_pks(manifest: DataFrame, tables: DataFrame) -> DataFrame:
    """``tables`` with the key list the manifest has for them; a comma string is split.  A table
    without one is marked as an error."""
    pk = F.col("pk") if dict(manifest.dtypes)["pk"].startswith("array") else split_keys(F.col("pk"))
    known = _named(manifest).groupBy(*NAMES).agg(F.min(pk).alias("pk"))
    out = _named(tables).join(known, NAMES, "left").drop(*NAMES)
    return out.withColumn("error", F.when(F.col("pk").isNull() | (F.size("pk") == 0), F.lit("no primary key in the manifest")))


def render_keys(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("pk", F.array_join("pk", ","))
