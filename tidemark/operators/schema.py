"""Schema changes: read from DDL events or snapshots, selected, and applied to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.spec import TableSpec

#: Columns of a schema change.
CHANGE = ["event_id", "schema_name", "table_name", "event_type", "column_name", "new_column_name"]


_ACTIONS = ", ".join(f"{k}: struct<Columns: struct<Name: array<string>>>" for k in ("Create", "Alter", "Drop"))
_EVENT = ", ".join(f"{k} string" for k in ("EventType", "SchemaName", "ObjectName", "ObjectType", "TargetObjectName", "NewObjectName")) + f", AlterTableActionList struct<{_ACTIONS}>"


def parse_ddl_events(events: DataFrame, specs: list[TableSpec] | DataFrame | None = None) -> DataFrame:
    """Schema changes in DDL events (id, ts, xml).

    ALTER_TABLE gives Add, Drop or Modify for the columns of the first kind of action that the event
    lists; RENAME of a column gives Rename (the table is the target object, the column the object).
    Other events, and tables or columns that aren't subscribed, give nothing.
    """
    kinds = {"Create": "Add", "Alter": "Modify", "Drop": "Drop"}
    x = F.from_xml("xml", F.lit(_EVENT))  # one pass over the text
    first = F.regexp_extract("xml", r"<AlterTableActionList>\s*<(\w+)", 1)
    read = events.select(F.col("id").alias("event_id"), "ts", x.alias("x"), first.alias("action")).select(
        "event_id", "ts", "action", F.col("x.EventType").alias("kind"), F.col("x.SchemaName").alias("schema_name"), F.col("x.ObjectName").alias("object"), F.col("x.ObjectType").alias("object_type"),
        F.col("x.TargetObjectName").alias("target"), F.col("x.NewObjectName").alias("new_name"), *[F.col(f"x.AlterTableActionList.{k}.Columns.Name").alias(k) for k in kinds],
    )
    columns = F.lit(None).cast("array<string>")
    label = F.lit(None).cast("string")
    for k, v in kinds.items():
        columns = F.when(F.col("action") == k, F.col(k)).otherwise(columns)
        label = F.when(F.col("action") == k, F.lit(v)).otherwise(label)
    alters = read.where("kind = 'ALTER_TABLE'").select("event_id", "ts", "schema_name", F.col("object").alias("table_name"), label.alias("event_type"), F.explode(columns).alias("column_name"), F.lit(None).cast("string").alias("new_column_name"))
    renames = read.where("kind = 'RENAME' and upper(object_type) = 'COLUMN' and target <> ''").select(
        "event_id", "ts", "schema_name", F.col("target").alias("table_name"), F.lit("Rename").alias("event_type"), F.col("object").alias("column_name"), F.col("new_name").alias("new_column_name")
    )
    out = alters.unionByName(renames)
    return out if specs is None else applicable_changes(out, specs)


def applicable_changes(changes: DataFrame, specs: list[TableSpec] | DataFrame) -> DataFrame:
    """Changes of configured tables and subscribed columns; many tables, all of whose columns are
    subscribed, can be given as a DataFrame (schema_name, table_name)."""
    if isinstance(specs, DataFrame):
        names = specs.select(F.lower("schema_name").alias("__s"), F.lower("table_name").alias("__t")).distinct()
        return changes.join(names, (F.lower("schema_name") == F.col("__s")) & (F.lower("table_name") == F.col("__t")), "left_semi")
    wanted = F.lit(False)
    for s in specs:
        here = F.lower(F.concat_ws(".", "schema_name", "table_name")) == f"{s.schema}.{s.name}".lower()
        if s.columns is not None:
            here = here & F.lower("column_name").isin([c.lower() for c in (*s.columns, *s.pk)])
        wanted = wanted | here
    return changes.where(wanted)


def attach_types(changes: DataFrame, columns: DataFrame) -> DataFrame:
    """Present types (data_type, length, precision, scale) of added and modified columns; a column
    that has gone since gives no change."""
    key = ["schema_name", "table_name", "column_name"]
    types = columns.select(*[F.lower(k).alias(f"__{k}") for k in key], "data_type", "length", "precision", "scale")
    on = [F.lower(k) == F.col(f"__{k}") for k in key]
    typed = changes.where(F.col("event_type").isin("Add", "Modify")).join(types, on).drop(*[f"__{k}" for k in key])
    return typed.unionByName(changes.where(~F.col("event_type").isin("Add", "Modify")), allowMissingColumns=True)


def diff_schemas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Drop, Add and Modify between two listings (schema_name, table_name, column_name, column_type);
    a table without a previous listing yields nothing."""
    key = ["schema_name", "table_name", "column_name"]
    a = previous.select(*key, F.col("column_type").alias("__old"))
    b = current.select(*key, "column_type")
    known = previous.select("schema_name", "table_name").distinct()
    out = a.join(b, key, "full_outer").join(known, ["schema_name", "table_name"], "left_semi")
    kind = F.when(F.col("column_type").isNull(), "Drop").when(F.col("__old").isNull(), "Add").when(F.col("__old") != F.col("column_type"), "Modify")
    return out.withColumn("event_type", kind).where("event_type is not null").select(*key, "event_type", "column_type")


def publish_schema_changes(events: DataFrame, columns: DataFrame, specs: list[TableSpec] | DataFrame, since) -> DataFrame:
    """Typed changes of events newer than the last successful start.  A column that is no longer there
    gives no change; one that is there but has no type in the listing is an error if it was added."""
    typed = attach_types(parse_ddl_events(events.where(F.col("ts") > F.lit(since)), specs), columns)
    missing = F.raise_error(F.concat(F.lit("no type for the added column "), F.concat_ws(".", "schema_name", "table_name", "column_name")))
    kind = F.when((F.col("event_type") == "Add") & F.col("data_type").isNull(), missing.cast("string")).otherwise(F.col("event_type"))
    return typed.withColumn("event_type", kind)


#: Spark types for base types of a change.
def _spark_type(kind: str, precision: int | None, scale: int | None) -> str:
    from tidemark.functions.types import SPARK_TYPES

    k = kind.lower()
    if k in ("decimal", "numeric"):
        return f"decimal({precision or 18},{scale or 0})"
    return SPARK_TYPES.get(k, k if k in ("string", "double", "boolean", "timestamp", "date", "long") else "string")


def evolve(df: DataFrame, changes: list[dict]) -> DataFrame:
    """A table with schema changes applied in order; repeating them changes nothing.

    Each change has event_type, column_name and, as needed, new_column_name, data_type, precision,
    scale.  Add only if absent; Drop, Modify and Rename only if present; renaming to an existing name
    is left out.  A handful of changes, so they are planned on the driver.
    """
    for c in changes:
        names = {x.lower(): x for x in df.columns}
        have = names.get(c["column_name"].lower())
        kind = c["event_type"]
        if kind in ("Add", "Modify"):
            to = _spark_type(c["data_type"], c.get("precision"), c.get("scale"))
            if kind == "Add" and have is None:
                df = df.withColumn(c["column_name"], F.lit(None).cast(to))
            elif kind == "Modify" and have is not None:
                df = df.withColumn(have, F.col(have).cast(to))
        elif kind == "Drop" and have is not None:
            df = df.drop(have)
        elif kind == "Rename" and have is not None and c["new_column_name"].lower() not in names:
            df = df.withColumnRenamed(have, c["new_column_name"])
        elif kind not in ("Drop", "Rename"):
            raise ValueError(f"unknown schema change {kind}")
    return df


def pk_columns(columns: DataFrame, key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Catalog columns with ``is_pk``: those used by a constraint of type PRIMARY KEY."""
    own = key_usage.join(constraints.where(F.upper("constraint_type") == "PRIMARY KEY"), ["schema_name", "table_name", "constraint_name"], "left_semi")
    keys = own.select("schema_name", "table_name", "column_name").distinct().withColumn("__pk", F.lit(True))
    return columns.join(keys, ["schema_name", "table_name", "column_name"], "left").withColumn("is_pk", F.coalesce("__pk", F.lit(False))).drop("__pk")


def views_to_refresh(changes: DataFrame, views: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Views (view_name) over changed tables: a leading ``vw`` stands for ``TBL``.

    With ``columns`` (table_name, column_name, and data_type if types are to agree), a change of a table
    or of its archive refreshes the view once it has been made in both: an added or renamed column is
    in both, a dropped one in neither, a modified one has the same type in both.
    """
    named = views.withColumn("table_name", F.regexp_replace("view_name", "(?i)^vw", "TBL"))
    renamed = F.col("new_column_name") if "new_column_name" in changes.columns else F.lit(None)
    column = F.when(F.col("event_type") == "Rename", F.coalesce(renamed, F.col("column_name"))).otherwise(F.col("column_name"))
    stem = lambda c: F.regexp_replace(F.lower(c), "archive$", "")
    tables = F.array(F.lower("table_name")) if columns is None else F.array_distinct(F.array(F.lower("table_name"), stem("table_name")))
    hit = changes.select(F.explode(tables).alias("__t"), column.alias("column_name"), "event_type").distinct()
    out = named.join(hit, F.lower("table_name") == F.col("__t")).drop("__t")
    if columns is not None:
        kind = F.lower("data_type") if "data_type" in columns.columns else F.lit("")
        side = columns.select(stem("table_name").alias("__t"), F.lower("column_name").alias("__c"), F.lower("table_name").alias("__table"), kind.alias("__kind"))
        tables = side.groupBy("__t").agg(F.count_distinct("__table").alias("__tables"))
        holders = side.groupBy("__t", "__c").agg(F.count_distinct("__table").alias("__have"), F.count_distinct("__kind").alias("__kinds"))
        out = out.join(tables, stem("table_name") == F.col("__t"), "left").drop("__t")
        out = out.join(holders, (stem("table_name") == F.col("__t")) & (F.lower("column_name") == F.col("__c")), "left")
        have, all_ = F.coalesce("__have", F.lit(0)), F.coalesce("__tables", F.lit(1))
        alike = (F.col("event_type") != "Modify") | (F.col("__kinds") <= 1)
        out = out.where(F.when(F.col("event_type") == "Drop", have == 0).otherwise((have == all_) & alike))
    return out.select("view_name", "table_name").distinct()
