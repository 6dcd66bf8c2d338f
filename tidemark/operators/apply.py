"""Applying a change set to a target: merge, delete-and-insert, replace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.changes import dedupe_changes, strip_meta
from tidemark.spec import META, OP, VERSION, TableSpec


def key_columns(df: DataFrame, spec: TableSpec) -> list[Column]:
    """The key as equi-join columns; string keys in upper case where case is ignored."""
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    fold = lambda c: spec.ignore_case and isinstance(kinds[c.lower()], StringType)
    return [F.upper(F.col(c)) if fold(c) else F.col(c) for c in spec.pk]


def keyed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """With the key as it is matched, in the columns ``key_names``."""
    return df.withColumns({f"__k{n}": c for n, c in enumerate(key_columns(df, spec))})


def key_names(spec: TableSpec) -> list[str]:
    return [f"__k{n}" for n in range(len(spec.pk))]


def _alone(df: DataFrame, names: list[str]) -> Column:
    """0, or for a row with a null in its key a number of its own contents: such rows match nothing,
    and as a further join key it keeps many of them from meeting in one task."""
    lone = F.lit(False)
    for k in names:
        lone = lone | F.col(k).isNull()
    return F.when(lone, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).otherwise(F.lit(0).cast("long"))


def merged(target: DataFrame, changes: DataFrame, spec: TableSpec, hit_only: bool = False) -> DataFrame:
    """Target and changes joined in full, with ``__action`` per row: KEEP, UPDATE, DELETE, INSERT,
    or null for a delete of a row that isn't there.  Null keys match nothing.  Two changes of one key
    are an error, as they are for a MERGE.  ``hit_only``: all rows of the target are matched, so columns
    that are sent need not be read from it (deleted rows then show the change's)."""
    names = key_names(spec)
    t = keyed(target, spec).withColumn("__t", F.lit(True))
    t = t.withColumn("__alone", F.lit(0).cast("long") if hit_only else _alone(target, names))
    cols = [c for c in changes.columns if c not in META]
    c = keyed(changes, spec)
    c = c.withColumn("__alone", _alone(changes, names))
    same = F.count(F.lit(1)).over(Window.partitionBy(*names, "__alone"))  # the join's own partitioning
    twice = F.raise_error(F.concat(F.lit(f"{spec.name}: more than one change of the key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in names])))
    c = c.withColumn("__same", same).withColumn(OP, F.when((F.col("__same") > 1) & (F.col("__alone") == 0), twice.cast("string")).otherwise(F.col(OP)))
    renamed = c.select(*names, "__alone", OP, *[F.col(x).alias(f"__c_{x}") for x in cols])
    out = t.join(renamed, [*names, "__alone"], "full_outer")
    hit, change = F.coalesce("__t", F.lit(False)), F.col(OP)
    action = F.when(hit & (change == "D"), "DELETE").when(hit & change.isNotNull(), "UPDATE").when(hit, "KEEP").when(change != "D", "INSERT")
    out = out.withColumn("__action", action)
    keys = {c.lower() for c in spec.pk}
    sent = {c.lower(): c for c in cols}
    values = []
    for c in target.columns:
        if c.lower() not in sent:
            values.append(F.col(c))
            continue
        new = F.col(f"__c_{sent[c.lower()]}").cast(target.schema[c].dataType)
        if hit_only and c.lower() not in keys:
            values.append(new.alias(c))
            continue
        takes = F.col("__action") == "INSERT" if c.lower() in keys else F.col("__action").isin("INSERT", "UPDATE")
        values.append(F.when(takes, new).otherwise(F.col(c)).alias(c))
    return out.select(*values, "__action")


def apply_merge(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Matched: delete on D, else update the columns sent (never the key); unmatched: insert on I or
    U.  A change set has one row per key (see ``dedupe_changes``)."""
    out = merged(target, changes, spec)
    return out.where(F.col("__action") != "DELETE").drop("__action")


def apply_delete_insert(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Delete every row whose key is in the change set, then insert its I and U rows.

    Columns not sent become null, the key takes the change's spelling, and repeated keys are
    inserted as often as they come.
    """
    c = keyed(changes, spec)
    kept = keyed(target, spec).join(c.select(*key_names(spec)), key_names(spec), "left_anti").select(*target.columns)
    new = strip_meta(c.where(F.col(OP).isin("I", "U"))).drop(*key_names(spec))
    return _cast_like(kept.unionByName(new, allowMissingColumns=True), target)


def apply_replace(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Delete keys with a D change, then replace rows by the I and U changes, the last per key."""
    dead = keyed(changes.where(F.col(OP) == "D"), spec).select(*key_names(spec))
    new = dedupe_changes(keyed(changes.where(F.col(OP).isin("I", "U")), spec), tuple(key_names(spec)))
    t = keyed(target, spec).join(dead, key_names(spec), "left_anti").join(new.select(*key_names(spec)), key_names(spec), "left_anti")
    return _cast_like(t.select(*target.columns).unionByName(strip_meta(new).drop(*key_names(spec)), allowMissingColumns=True), target)


def delete_inserted(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of both with ``__action`` as delete-and-insert treats them: DELETE for keys in the change set,
    INSERT for its I and U rows, KEEP."""
    return _swapped(target, changes, changes.where(F.col(OP).isin("I", "U")), spec)


def replaced(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of both with ``__action`` as a replace treats them: the last I or U row of a key is inserted,
    also where the key has a D row."""
    names = key_names(spec)
    new = dedupe_changes(keyed(changes.where(F.col(OP).isin("I", "U")), spec), tuple(names)).drop(*names)
    return _swapped(target, changes, new, spec)


def _swapped(target: DataFrame, changes: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    sent = keyed(changes, spec).select(*key_names(spec)).distinct().withColumn("__sent", F.lit(True))
    action = F.when(F.col("__sent"), "DELETE").otherwise("KEEP").alias("__action")
    old = keyed(target, spec).join(sent, key_names(spec), "left").select(*[F.col(f"`{c}`") for c in target.columns], action)
    put = _cast_like(target.limit(0).unionByName(strip_meta(new), allowMissingColumns=True), target)
    return old.unionByName(put.withColumn("__action", F.lit("INSERT")))


def _cast_like(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema])


def apply_counts(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: inserted counts inserts and updates, deleted counts deletes and updates."""
    actions = merged(target, changes, spec)
    return actions.agg(
        F.count_if(F.col("__action").isin("INSERT", "UPDATE")).alias("inserted"), F.count_if(F.col("__action").isin("DELETE", "UPDATE")).alias("deleted")
    )


def newer_only(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Changes that are newer than the version the target keeps of their key in ``_version``."""
    have = keyed(target, spec).select(*key_names(spec), F.col(VERSION).alias("__have"))
    out = keyed(changes, spec).join(have, key_names(spec), "left")
    return out.where(F.col("__have").isNull() | (F.col(VERSION) > F.col("__have"))).select(*changes.columns)


def pair_archives(manifest: DataFrame, suffix: str = "Archive") -> DataFrame:
    """(base, archive) units to apply together: a table with its archive if both have changes; a
    lone table or archive is a unit by itself.  The order of the manifest doesn't matter."""
    names = manifest.select("table_name").distinct()
    stem = names.withColumn("stem", F.regexp_replace("table_name", f"(?i){suffix}$", ""))
    got = stem.groupBy(F.lower("stem").alias("unit")).agg(
        F.max(F.when(F.lower("table_name") == F.lower("stem"), F.col("table_name"))).alias("base"),
        F.max(F.when(F.lower("table_name") != F.lower("stem"), F.col("table_name"))).alias("archive"),
    )
    return got.select(F.coalesce("base", "archive").alias("table_name"), F.when(F.col("base").isNotNull(), F.col("archive")).alias("archive_name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
