"""Cyclic positions of timestamps in radians, their inverses, and shifts."""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCLE = 2 * math.pi


class Period(str, Enum):
    MINUTE = "minute"
    HOUR = "hour"
    DAY = "day"
    WEEK = "week"
    MONTH = "month"
    YEAR = "year"


#: Seconds of each period.
SECONDS = {Period.MINUTE: 60.0, Period.HOUR: 3600.0, Period.DAY: 86400.0, Period.WEEK: 604800.0, Period.MONTH: 30.437 * 86400, Period.YEAR: 365.25 * 86400}


def convert_timestamp(value: Column) -> Column:
    """A string as a timestamp without zone; null if it isn't one."""
    return F.try_to_timestamp(value).cast("timestamp_ntz")


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def minute_per_hour(ts: Column) -> Column:
    return F.minute(ts) / 60.0 * CIRCLE


def hour_per_day(ts: Column) -> Column:
    """The nearest hour, 24 after half past 23."""
    return (F.hour(ts) + (F.minute(ts) >= 30).cast("int")) / 24.0 * CIRCLE


def day_per_week(ts: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return (F.weekday(ts) + 1) / 7.0 * CIRCLE


def day_per_month(ts: Column) -> Column:
    return F.dayofmonth(ts) / days_in_month(ts) * CIRCLE


def day_per_year(ts: Column) -> Column:
    return F.dayofyear(ts) / F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))) * CIRCLE


def week_per_month(ts: Column) -> Column:
    return F.round(F.dayofmonth(ts) / 7.0, 1) / F.floor(days_in_month(ts) / 7.0) * CIRCLE


def week_per_year(ts: Column) -> Column:
    return F.round(F.dayofyear(ts) / 7.0, 1) / 52.1775 * CIRCLE


def month_per_year(ts: Column) -> Column:
    return F.month(ts) / 12.0 * CIRCLE


P = Period
RATIOS = {
    (P.MINUTE, P.HOUR): minute_per_hour, (P.HOUR, P.DAY): hour_per_day, (P.DAY, P.WEEK): day_per_week, (P.DAY, P.MONTH): day_per_month,
    (P.DAY, P.YEAR): day_per_year, (P.WEEK, P.MONTH): week_per_month, (P.WEEK, P.YEAR): week_per_year, (P.MONTH, P.YEAR): month_per_year,
}
#: How many of the one make the other.
TURNS = {(P.MINUTE, P.HOUR): 60.0, (P.HOUR, P.DAY): 24.0, (P.DAY, P.WEEK): 7.0, (P.DAY, P.MONTH): 30.437, (P.DAY, P.YEAR): 365.25, (P.WEEK, P.MONTH): 4.345, (P.WEEK, P.YEAR): 52.1775, (P.MONTH, P.YEAR): 12.0}


def inverse(angle: Column, numerator: Period, denominator: Period) -> Column:
    """The position on the cycle, in numerators, of an angle in radians."""
    return angle * TURNS[Period(numerator), Period(denominator)] / CIRCLE


def angle(sin: Column, cos: Column) -> Column:
    """In [0, 2 pi)."""
    raw = F.atan2(sin, cos)
    return F.when(raw < 0, raw + CIRCLE).otherwise(raw)


def localize_timestamp(ts: Column, hours: Column) -> Column:
    """Shifted by whole hours; no daylight saving."""
    return ts + F.make_dt_interval(F.lit(0), F.coalesce(hours, F.lit(0)))


def delta_seconds(a: Column, b: Column, compat: bool = False) -> Column:
    """Whole seconds between two timestamps, without sign; ``compat`` drops whole days."""
    seconds = F.floor(F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 1_000_000)
    return F.pmod(seconds, F.lit(86400)) if compat else seconds
