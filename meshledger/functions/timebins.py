"""Time arithmetic on wall-clock (NTZ) timestamps. Nothing here depends on the session zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def midnight(ts: Column | str) -> Column:
    return day(ts).cast("timestamp_ntz")


def hour_start(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def week_ending(date: Column | str, weekday: str = "MON") -> Column:
    """The closing day of the week a date falls in; a closing day belongs to its own week."""
    return F.next_day(F.date_sub(day(date), 1), weekday)


def month_end(date: Column | str) -> Column:
    return F.last_day(day(date))


def weekday_name(date: Column | str) -> Column:
    return F.date_format(day(date), "EEEE")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds as a double, exact to the microsecond."""
    return (_col(end) - _col(start)).cast("interval second").cast("decimal(18,6)").cast("double")


def days_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def plus_seconds(ts: Column | str, seconds: int) -> Column:
    return _col(ts) + F.expr(f"make_dt_interval(0, 0, 0, {int(seconds)})")


def seconds_since_epoch(ts: Column | str) -> Column:
    return (_col(ts) - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)").cast("double")


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Number of the fixed-length bucket a timestamp falls in; grows with time."""
    elapsed = (_col(ts) - F.expr(_EPOCH)).cast("bigint")
    return F.floor(elapsed / F.lit(int(seconds))).cast("bigint")


def slice_start(ts: Column | str, hours: int) -> Column:
    """Start of the slice of ``hours`` length a timestamp falls in."""
    number = time_bucket(ts, hours * 3600)
    return F.expr(_EPOCH) + number * F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")


def value_bucket(value: Column | str) -> Column:
    """A bucket number that never falls as the value grows, finer for small values.

    64 buckets per doubling, so a few thousand cover any 64-bit magnitude.
    """
    v = _col(value).cast("double")
    return F.floor(F.signum(v) * F.log2(F.abs(v) + F.lit(1.0)) * F.lit(64.0)).cast("bigint")
