"""Time arithmetic that does not depend on the session time zone.

The tables carry `timestamp_ntz`. Casting those to `timestamp` would make the
answers depend on the session zone, so differences are built from the calendar
fields instead, which are zone-free for NTZ columns.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, functions as F, types as T


def moment(value: Any = None) -> Column:
    """A point in time as NTZ: a column, datetime, date or ISO text; now if None."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def epoch_days(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def epoch_hours(ts: Column) -> Column:
    return epoch_days(ts).cast("bigint") * 24 + F.hour(ts)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970."""
    return epoch_hours(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    sub = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return (epoch_hours(ts) * 3600 + F.minute(ts) * 60) * 1000000 + sub


def from_epoch_micros(us: Column) -> Column:
    """Inverse of `epoch_micros`."""
    seconds = (us / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds
    )


def instant_micros(c: Column, data_type: T.DataType) -> Column:
    """Position on the UTC time line, whatever kind of time the column holds.
    Numbers are taken as they are."""
    if isinstance(data_type, T.TimestampNTZType):
        return epoch_micros(c)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("bigint") * 86_400_000_000
    return c.cast("bigint")


def utc(c: Column, data_type: T.DataType) -> Column:
    """A `timestamp` column as NTZ in UTC; other columns unchanged."""
    return from_epoch_micros(F.unix_micros(c)) if isinstance(data_type, T.TimestampType) else c


def hours_crossed(earlier: Column, later: Column) -> Column:
    """Number of hour boundaries between two times (00:59 to 01:01 is 1)."""
    return epoch_hours(later) - epoch_hours(earlier)


def hours_elapsed(earlier: Column, later: Column) -> Column:
    """Whole elapsed hours, rounded towards zero (00:59 to 01:01 is 0)."""
    return F.expr("cast(0 as bigint)") + (
        (epoch_micros(later) - epoch_micros(earlier)) / F.lit(3600000000.0)
    ).cast("bigint")


def interval(days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))
