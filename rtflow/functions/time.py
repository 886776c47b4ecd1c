"""Time functions, as native columns and as SQL functions of the same names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

#: Fixed value: the text form of every time column in the output.
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"


def _shift(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(hours)} HOURS") if hours else ts


def time2str(ts: Column | str, offset_hours: int = 0) -> Column:
    """Format a timestamp as text in the session time zone, moved by ``offset_hours``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(_shift(ts, offset_hours), TIME_PATTERN)


def utc2local(ts: Column | str, offset_hours: int = 8) -> Column:
    """Move a timestamp by the local offset (8 hours unless told otherwise)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return _shift(ts, offset_hours)


def register_functions(spark: SparkSession, offset_hours: int = 0, local_hours: int = 8) -> None:
    """Make ``time2str`` and ``utc2local`` callable from SQL text and ``F.expr``.

    They are SQL functions: Catalyst inlines their bodies, so no Python worker is involved.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION time2str(t TIMESTAMP) RETURNS STRING "
        f"RETURN date_format(t + INTERVAL {int(offset_hours)} HOURS, '{TIME_PATTERN}')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION utc2local(t TIMESTAMP) RETURNS TIMESTAMP "
        f"RETURN t + INTERVAL {int(local_hours)} HOURS"
    )
