"""Timetables expanded from headway rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MINUTES_PER_DAY
from ..schema import WEEKDAYS


@dataclass(frozen=True)
class Headway:
    """Departures from ``first`` to ``last``, in minutes of the day."""

    first: int
    last: int
    every: int
    ride: int
    peak: bool

    @property
    def departures(self) -> int:
        return (self.last - self.first) // self.every + 1


# fixed values: the two rule sets (minutes of the day)
IMPORT_RULES = (
    Headway(first=7 * 60, last=8 * 60 + 50, every=10, ride=25, peak=True),
    Headway(first=9 * 60, last=16 * 60 + 40, every=20, ride=20, peak=False),
    Headway(first=17 * 60, last=18 * 60 + 50, every=10, ride=30, peak=True),
    Headway(first=19 * 60, last=22 * 60 + 40, every=20, ride=20, peak=False),
)
SEED_RULES = (
    Headway(first=6 * 60, last=9 * 60 + 45, every=15, ride=25, peak=True),
    Headway(first=10 * 60, last=16 * 60 + 30, every=30, ride=28, peak=False),
    Headway(first=17 * 60, last=20 * 60 + 45, every=15, ride=27, peak=True),
)


def expand_timetable(
    routes: DataFrame,
    rules: Sequence[Headway],
    extra_ride: Column | None = None,
    days: Sequence[str] = WEEKDAYS,
) -> DataFrame:
    """All departures of the week for every route.

    Each route row is unfolded where it lies, without a join or a shuffle; ids
    follow from the route id and the place in the week. Arrivals after midnight
    wrap around.
    """
    per_day = sum(rule.departures for rule in rules)
    blocks, done = [], 0
    for rule in rules:
        values = (rule.first, rule.last, rule.every, rule.ride, rule.peak, done)
        blocks.append(F.struct(*[F.lit(v) for v in values]))
        done += rule.departures
    extra = F.lit(0) if extra_ride is None else extra_ride
    names = ("first", "last", "every", "ride", "is_peak_hour", "offset")
    week = (
        routes.select("route_id", extra.alias("extra"))
        .select(
            "*",
            F.posexplode(F.array(*[F.lit(d) for d in days])).alias(
                "day", "day_of_week"
            ),
        )
        .select("*", F.inline(F.array(*blocks)).alias(*names))
        .select(
            "*",
            F.posexplode(F.sequence("first", "last", "every")).alias(
                "position", "departure_min"
            ),
        )
    )
    place = F.col("day") * per_day + F.col("offset") + F.col("position")
    arrival = F.col("departure_min") + F.col("ride") + F.col("extra")
    return week.select(
        (F.col("route_id") * (per_day * len(days)) + place).alias("schedule_id"),
        "route_id",
        "day_of_week",
        "departure_min",
        F.pmod(arrival, F.lit(MINUTES_PER_DAY)).cast("int").alias("arrival_min"),
        "is_peak_hour",
    )


def timetable_importer(routes: DataFrame) -> DataFrame:
    """60 departures per route and day, every 10 or 20 minutes."""
    return expand_timetable(routes, IMPORT_RULES)


def timetable_seed(routes: DataFrame) -> DataFrame:
    """46 departures per route and day; the ride depends on the route id."""
    return expand_timetable(routes, SEED_RULES, F.col("route_id") % 10)
