"""Dates, minutes of the day and look-back windows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import WEEKDAYS

MINUTES_PER_DAY = 24 * 60


def first_instant(as_of: datetime | None, days: int) -> Column:
    """The instant ``days`` before ``as_of`` (default: now), zone-free."""
    if as_of is None:
        return F.localtimestamp() - F.make_dt_interval(F.lit(days))
    bound = as_of - timedelta(days=days)
    return F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")


def first_day(as_of: datetime | None, days: int) -> Column:
    """The day ``days`` before ``as_of`` (default: today)."""
    if as_of is None:
        return F.date_sub(F.current_date(), days)
    return F.lit((as_of - timedelta(days=days)).date())


def instant(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def sunday_based_weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday (Spark counts from 1)."""
    return F.dayofweek(day) - 1


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def hour_of_minute(minute: Column) -> Column:
    return F.floor(minute / 60).cast("int")


def clock(minute: Column) -> Column:
    """Minute of the day as ``HH:MM:SS`` text."""
    day_minute = F.pmod(minute, F.lit(MINUTES_PER_DAY))
    hours = F.lpad(hour_of_minute(day_minute).cast("string"), 2, "0")
    rest = F.lpad((day_minute % 60).cast("string"), 2, "0")
    return F.concat(hours, F.lit(":"), rest, F.lit(":00"))


def in_hours(at: Column, hours: Iterable[int]) -> Column:
    return F.hour(at).isin(*hours)


def weekday_rank(name: Column) -> Column:
    """1 for Monday to 7 for Sunday; NULL for anything else."""
    position = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), name)
    return F.nullif(position, F.lit(0))


def weekday_name(value: Column) -> Column:
    """Day names from either names or the digits 0 (Sunday) to 6."""
    sunday_first = (WEEKDAYS[-1], *WEEKDAYS[:-1])
    pairs = [(str(number), name) for number, name in enumerate(sunday_first)]
    text = value.cast("string")
    start = F.when(text == pairs[0][0], pairs[0][1])
    digits = reduce(lambda chain, p: chain.when(text == p[0], p[1]), pairs[1:], start)
    return digits.otherwise(text)
