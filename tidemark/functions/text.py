"""Text made safe for delimited loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Replacements in the order in which they are made.
ESCAPES = (("\\", "\\\\"), ("\r\n", " "), ('"', '\\"'), ("|", ","), ("\n", " "), ("NULL", "\\NULL"))
#: Dialects that write a null as the text NULL.
NULL_AS_TEXT = {"netezza"}


def escaped(value: Column, dialect: str) -> Column:
    for old, new in ESCAPES:
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.coalesce(value, F.lit("NULL")) if dialect in NULL_AS_TEXT else value


def escape_text(df: DataFrame, dialect: str) -> DataFrame:
    """All string columns escaped for the dialect's loader."""
    return df.withColumns({f.name: escaped(F.col(f.name), dialect) for f in df.schema if isinstance(f.dataType, StringType)})
