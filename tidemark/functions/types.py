"""Types of other databases: mapping by table, length and precision rules, conforming values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark types of source types that keep no length or precision.
SPARK_TYPES = {
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint",
    "money": "decimal(20,4)", "smallmoney": "decimal(20,4)", "float": "double", "real": "double",
    "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz",
    "binary": "binary", "varbinary": "binary", "image": "binary", "uniqueidentifier": "string",
}


MAPPING = "source string, dest string, source_type string, dest_type string"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(source, dest, source_type, dest_type) from a tab-separated file whose header names the two
    databases and whose lines have a type's name in each."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if len(raw.columns) != 2:
        raise ValueError(f"a type mapping has two columns, not {raw.columns}")
    a, b = raw.columns
    return raw.select(F.lit(a.strip()).alias("source"), F.lit(b.strip()).alias("dest"), F.trim(F.col(f"`{a}`")).alias("source_type"), F.trim(F.col(f"`{b}`")).alias("dest_type"))


def map_types(columns: DataFrame, mapping: DataFrame, source: str, dest: str) -> DataFrame:
    """``columns`` with ``mapped``: the target's name of ``data_type``; unmapped names pass through.

    A pair of databases without any mapping is an error; of several lines of a type the least counts.
    """
    own = mapping.where((F.lower("source") == source.lower()) & (F.lower("dest") == dest.lower()))
    if own.limit(1).count() == 0:
        raise ValueError(f"no type mapping from {source} to {dest}")
    names = own.groupBy(F.lower("source_type").alias("__type")).agg(F.min("dest_type").alias("__to"))
    out = columns.join(names, F.lower("data_type") == F.col("__type"), "left")
    return out.withColumn("mapped", F.coalesce("__to", "data_type")).drop("__type", "__to")


def uses_length(kind: Column) -> Column:
    return F.lower(kind).rlike("char|binary")


def uses_precision(kind: Column) -> Column:
    return F.lower(kind).rlike("decimal|numeric|money|real|float")


def is_text(kind: Column) -> Column:
    return F.lower(kind).rlike("text|char|^xml$")


def _sized(kind: Column, *numbers: Column, sep: str = ",") -> Column:
    """A type's name with numbers in brackets; null ones are left out, and so are empty brackets."""
    inside = F.concat_ws(sep, *[n.cast("string") for n in numbers])
    return F.when(inside == "", kind).otherwise(F.concat(kind, F.lit("("), inside, F.lit(")")))


# Types that keep their length or precision on the way to Vertica, and to SQL Server from MySQL.
VERTICA_SIZED, VERTICA_PRECISE = ["binary", "char", "nchar", "nvarchar", "varbinary", "varchar"], ["decimal", "money", "numeric", "smallmoney"]
MSSQL_SIZED, MSSQL_PRECISE = ["varchar", "nvarchar", "char", "nchar", "text", "ntext"], ["decimal", "numeric", "real", "float"]


def target_type(columns: DataFrame, dialect: str, cap: int | None = None) -> DataFrame:
    """``columns`` (data_type, mapped, length, precision, scale, optional modifier) with ``target``, the
    type's text on the target.  ``modifier``: the length a column is shortened to.

    netezza, mysql: a mapped name stays, with the modifier in place of a length in it; other types with
    a length get the modifier, else (netezza) the length, ``cap`` where it is longer or unlimited, 16000
    where it is unlimited without a cap, or (mysql) the length and ``longtext`` if unlimited; precise
    types get precision and scale.  vertica: the modifier replaces a length in the mapped name or is
    put to it; else, by the source type, the length up to ``cap`` (65000) or precision and scale, if
    known.  mssql: lengths below 8000, else MAX; precision, 18 if unknown, and scale.
    """
    source, kind, n = F.lower("data_type"), F.col("mapped"), F.col("length")
    precision, scale = F.col("precision"), F.col("scale")
    modifier = (F.col("modifier") if "modifier" in columns.columns else F.lit(None)).cast("int")
    bracketed, held = kind.rlike(r"\([0-9]+\)$"), modifier.isNotNull()
    replaced = F.regexp_replace(kind, r"[0-9]+", F.coalesce(modifier.cast("string"), F.lit("")))
    renamed = F.lower(kind) != source
    if dialect == "netezza":
        unlimited = F.lit(cap if cap else 16000)
        size = F.when(n < 1, unlimited).when(n > (cap or 2**31 - 1), unlimited).otherwise(n)
        plain = F.when(uses_length(kind), _sized(kind, F.coalesce(modifier, size))).when(uses_precision(kind), _sized(kind, precision, scale)).otherwise(kind)
        target = F.when(renamed, F.when(held & bracketed, replaced).otherwise(kind)).otherwise(plain)
    elif dialect == "mysql":
        plain = F.when(uses_length(kind), F.when(held, _sized(kind, modifier)).when(n == -1, F.lit("longtext")).otherwise(_sized(kind, n)))
        plain = plain.when(uses_precision(kind), _sized(kind, precision, scale)).otherwise(kind)
        target = F.when(renamed, F.when(held & bracketed, replaced).otherwise(kind)).otherwise(plain)
    elif dialect == "vertica":
        most = cap or 65000
        size = F.when((n == -1) | (n > most), F.lit(most)).otherwise(n)
        own = F.when(source.isin(VERTICA_SIZED) & n.isNotNull(), _sized(kind, size))
        own = own.when(source.isin(VERTICA_PRECISE) & precision.isNotNull() & scale.isNotNull(), _sized(kind, precision, scale, sep=", ")).otherwise(kind)
        target = F.when(held & bracketed, replaced).when(held, _sized(kind, modifier)).otherwise(own)
    elif dialect == "mssql":
        size = F.when(n < 8000, n.cast("string")).otherwise(F.lit("MAX"))
        target = F.when(F.lower(kind).isin(MSSQL_SIZED), _sized(kind, size)).when(F.lower(kind).isin(MSSQL_PRECISE), _sized(kind, F.coalesce(precision, F.lit(18)), scale)).otherwise(kind)
    else:
        raise ValueError(f"unknown dialect {dialect}")
    return columns.withColumn("target", target)


def conform(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Columns cast to Spark types; ``varchar(n)`` and ``char(n)`` are cut at n characters."""
    out = {}
    for name, kind in targets.items():
        k = kind.lower()
        if k.startswith(("varchar(", "char(", "nvarchar(", "nchar(")):
            out[name] = F.left(F.col(name).cast("string"), F.lit(int(k.split("(")[1].rstrip(") "))))
        else:
            out[name] = F.col(name).cast(kind)
    return df.withColumns(out)
