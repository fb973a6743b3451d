"""Times on the wall clock of UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = (T.TimestampType, T.TimestampNTZType)


def utc_wall(c: Column, kind: T.DataType) -> Column:
    """A time as ``timestamp_ntz``: one with a zone is moved to UTC, one without stays; other kinds are cast."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return c.cast("timestamp_ntz")


def utc_text(c: Column, kind: T.DataType, digits: int = 6) -> Column:
    """ISO 8601 with ``digits`` of the second's fraction and a Z."""
    s = utc_wall(c, kind).cast("string")
    return F.concat(F.substr(s, F.lit(1), F.lit(10)), F.lit("T"), F.substr(s, F.lit(12), F.lit(8)), F.lit("."), F.rpad(F.substr(s, F.lit(21), F.lit(digits)), digits, "0"), F.lit("Z"))
