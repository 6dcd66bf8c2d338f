"""Delimited files as loaders of other databases want them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.functions.text import escape_text


@dataclass(frozen=True)
class Dialect:
    """field, record: delimiters.  escape: which rules of ``escape_text`` apply on export, if any.
    blank: text that stands for an empty string where an empty field is a null."""

    field: str = "|"
    record: str = "\n"
    escape: str | None = None
    blank: str | None = None


# The delimiters and the mark of an empty string that loaders expect.
NETEZZA = Dialect(escape="netezza")
VERTICA = Dialect(escape="vertica")
STRICT = Dialect(record="\r\n")
MYSQL = Dialect(record="&_+-!/=/=", blank=" " * 10)


def write_delimited(df: DataFrame, path: str, dialect: Dialect = NETEZZA) -> None:
    """One line of text a row; nulls are empty fields unless the escape rules name them."""
    out = escape_text(df, dialect.escape) if dialect.escape else df
    fields = []
    for f in df.schema:
        value = F.col(f.name).cast("string")
        if dialect.blank is not None and isinstance(f.dataType, StringType):
            value = F.when(value == "", F.lit(dialect.blank)).otherwise(value)
        fields.append(F.coalesce(value, F.lit("")))
    line = F.concat_ws(dialect.field, *fields).alias("value")
    out.select(line).write.mode("overwrite").option("lineSep", dialect.record).text(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType, dialect: Dialect = MYSQL) -> DataFrame:
    """Fields split and cast by the schema: an empty one is null, the blank mark an empty string."""
    raw = spark.read.option("lineSep", dialect.record).text(path)
    parts = raw.select(F.split("value", _literal(dialect.field), -1).alias("x"))
    cols = []
    for n, f in enumerate(schema):
        value = F.nullif(F.get("x", F.lit(n)), F.lit(""))
        if dialect.blank is not None:
            value = F.when(value == dialect.blank, F.lit("")).otherwise(value)
        cols.append(value.cast(f.dataType).alias(f.name))
    return parts.select(*cols)


def read_strict(spark: SparkSession, path: str, schema: StructType, sep: str = "|", record: str = "\r\n") -> DataFrame:
    """Any bad record (a wrong number of fields, a value that isn't of its type) fails the load; an
    empty field is null.  Records end in ``record``, nothing is quoted."""
    raw = spark.read.option("lineSep", record).text(path)
    parts = raw.select("value", F.split("value", _literal(sep), -1).alias("x"))
    bad = F.raise_error(F.concat(F.lit("malformed record: "), F.left("value", F.lit(200))))
    whole = F.when(F.size("x") == len(schema), F.col("x")).otherwise(bad.cast("array<string>"))
    cols = []
    for n, f in enumerate(schema):
        value = F.nullif(F.get("x", F.lit(n)), F.lit(""))
        cast = value.try_cast(f.dataType)
        cols.append(F.when(value.isNull() | cast.isNotNull(), cast).otherwise(bad.cast(f.dataType)).alias(f.name))
    return parts.select("value", whole.alias("x")).select(*cols)


def _literal(text: str) -> Column:
    """A pattern that matches just ``text``."""
    return F.regexp_replace(F.lit(text), r"([\W])", r"\\$1")


def read_tolerant(spark: SparkSession, path: str, schema: StructType, lengths: dict[str, int] | None = None, sep: str = "|") -> DataFrame:
    """Latin-1 text with zero bytes and carriage returns removed, missing trailing fields null,
    escapes undone, long strings cut."""
    texts = StructType([type(f)(f.name, StringType()) for f in schema])
    raw = spark.read.csv(path, schema=texts, sep=sep, encoding="ISO-8859-1", quote="", escape="\\", mode="PERMISSIVE")
    out = []
    for f in schema:
        value = F.nullif(F.translate(f.name, "\x00\r", ""), F.lit(""))
        n = (lengths or {}).get(f.name)
        out.append((F.left(value, F.lit(n)) if n and isinstance(f.dataType, StringType) else value).cast(f.dataType).alias(f.name))
    return raw.select(*out)
