"""Rows and times as text and numbers, and back: columns only, no pickles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def serialize(*cols: str | Column) -> Column:
    """A row's columns as JSON under their names, nulls kept; bytes as base64, times in ISO form."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def deserialize(data: str | Column, schema: StructType | str, strict: bool = True) -> Column:
    """The typed row of serialize(). Where text does not fit the schema: an error if `strict`, else null fields."""
    return F.from_json(F.col(data) if isinstance(data, str) else data, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def iso_time(time: Column) -> Column:
    """ISO 8601 text of a timestamp, in the session's time zone, microseconds where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(time) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))).otherwise(F.lit("")))


def total_seconds(begin: Column, end: Column) -> Column:
    """Seconds from one timestamp to another, with a fraction."""
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(1e6)


def milliseconds(time: Column) -> Column:
    """Whole milliseconds since 1970 of a timestamp, rounded down."""
    return F.unix_millis(time)
