"""Column functions: progress bits, text escapes, type rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a batch and their bits in the ledger.
PUBLISH_SCHEMA, CAPTURE, UPLOAD, APPLY_SCHEMA, CONSOLIDATE, DOWNLOAD, APPLY, HISTORY = (1 << k for k in range(8))
COMPLETE = 255


def has_bit(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) > 0


def with_bit(bits: Column, bit: int) -> Column:
    return bits.bitwiseOR(F.lit(bit))


def time_of_day(ts: Column) -> Column:
    """Sortable time of day as text."""
    return F.date_format(ts, "HH:mm:ss")


def integer_suffix(name: Column) -> Column:
    """The integer after the last underscore of a name, null where there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"_([0-9]{1,18})$", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def split_keys(text: Column) -> Column:
    """A comma-separated key list as an array without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def shortened(value: Column, n: int) -> Column:
    return F.left(value.cast("string"), F.lit(n))
