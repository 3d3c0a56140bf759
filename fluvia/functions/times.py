"""Dates and times: zones, seasons, slots, spans."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/London"


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def slot(ts: Column) -> Column:
    """Half-hour of the day, 0 to 47."""
    return F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int")


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9)


def year_angle(d: Column) -> Column:
    return F.lit(2 * pi) * F.dayofyear(d) / F.lit(365.25)


def season_day(d: Column) -> Column:
    """Day of the year; October to January held at 30 September, February to April at 1 May (leap aware)."""
    end = F.dayofyear(F.make_date(F.year(d), F.lit(9), F.lit(30)))
    start = F.dayofyear(F.make_date(F.year(d), F.lit(5), F.lit(1)))
    m = F.month(d)
    return F.when((m >= 10) | (m == 1), end).when(m < 5, start).otherwise(F.dayofyear(d))


def season_start(d: Column) -> Column:
    """The latest 1 May."""
    return F.make_date(F.year(d) - (F.month(d) < 5).cast("int"), F.lit(5), F.lit(1))


def in_season(d: Column) -> Column:
    return F.month(d).between(5, 9)


def span_days(start: Column, end: Column, cap: int = 60) -> Column:
    """Days touched by an interval, at most `cap` days beyond the first; a negative one is its first day."""
    a, b = F.to_date(start), F.to_date(F.coalesce(end, start))
    return F.sequence(a, F.greatest(a, F.least(b, F.date_add(a, cap))))


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
