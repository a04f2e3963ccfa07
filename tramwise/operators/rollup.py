"""Reports from stored partial sums instead of the facts.

A rollup holds exact sums, counts, squares and extremes of groups of rows. Rollups of
parts of a fact add up to that of the whole, so loads store one of each new part and
every report here adds up what it needs. The results are those of the reports of the
same name over the facts.

Distinct riders cannot be added up, but sets of them can be united: they are kept as
64-bit words over card numbers, for each day, route and hour, and united over any range
of days without reading a trip.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calendar import first_day, hour_of_minute
from ..functions.order import ordered
from ..functions.stats import (
    count_rows,
    deviation,
    minutes,
    or_zero,
    ratio,
    rounded,
    sum_of_squares,
)
from ..schema import DERIVED_LAYOUTS
from ..sources.tables import Tables
from . import performance
from .common import dealt, delay, equals, only, passengers, ride_minutes, route_identity
from .performance import mean_of
from .ridership import fare

VALUES = ("ride", "planned", "delay", "load")


# -- What loads store ---------------------------------------------------------


def _typed(frame: DataFrame, name: str) -> DataFrame:
    fields = StructType.fromDDL(DERIVED_LAYOUTS[name]).fields
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def log_rollup(logs: DataFrame) -> DataFrame:
    """Sums of the logs by date, hour, route, peak flag and weather."""
    values = {
        "ride": ride_minutes(),
        "planned": minutes("scheduled_duration_minutes"),
        "delay": delay(),
        "load": passengers(),
    }
    sums = logs.groupBy(
        "log_date",
        hour_of_minute(F.col("log_min")).alias("hour_of_day"),
        "route_id",
        "is_peak_hour",
        "weather_condition",
    ).agg(
        count_rows().alias("n"),
        *[F.sum(values[v]).alias(f"sum_{v}") for v in VALUES],
        *[F.count(values[v]).alias(f"n_{v}") for v in VALUES],
        sum_of_squares(delay()).alias("squares"),
        F.min(delay()).alias("min_delay"),
        F.max(delay()).alias("max_delay"),
        F.max(passengers()).alias("max_load"),
    )
    return _typed(sums, "log_rollup")


def load_counts(logs: DataFrame) -> DataFrame:
    """How often each route carried each number of passengers."""
    counts = logs.groupBy("route_id", "passenger_count").agg(count_rows().alias("n"))
    return _typed(counts, "load_counts")


def trip_rollup(trips: DataFrame) -> DataFrame:
    """Trips and fares by date, route and hour of tap-in."""
    keys = ("trip_date", "route_id", "hour")
    taps = trips.select(
        "trip_date", "route_id", F.hour("tap_in_time").alias("hour"), fare().alias("fare")
    )
    sums = dealt(taps, trips.count(), *keys).groupBy(*keys).agg(
        count_rows().alias("n"),
        F.sum("fare").alias("sum_fare"),
        F.count("fare").alias("n_fare"),
    )
    return _typed(sums, "trip_rollup")


def rider_sets(trips: DataFrame) -> DataFrame:
    """The cards of every day, and of its routes and hours, as bits of words.

    A word covers 64 neighbouring card numbers; words without riders are not stored, so
    few riders of a route and day take as many words at most. One scan serves the three
    grains.
    """
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), F.lit(None).cast("bigint").alias("key")),
        F.struct(F.lit("route").alias("grain"), F.col("route_id").alias("key")),
        F.struct(
            F.lit("hour").alias("grain"),
            F.hour("tap_in_time").cast("bigint").alias("key"),
        ),
    )
    taps = trips.filter(F.col("card_id").isNotNull()).select(
        "trip_date",
        F.shiftright(F.col("card_id").cast("bigint"), 6).alias("bucket"),
        F.expr("shiftleft(1L, cast(card_id & 63 as int))").alias("card"),
        F.inline(grains),
    )
    keys = ("grain", "trip_date", "key", "bucket")
    sets = dealt(taps, 3 * trips.count(), *keys).groupBy(*keys).agg(
        F.bit_or("card").alias("cards")
    )
    return _typed(sets, "rider_sets")


def card_counts(trips: DataFrame) -> DataFrame:
    """Trips and the last day of every card."""
    counts = trips.groupBy("card_id").agg(
        count_rows().alias("n"), F.max("trip_date").alias("last_trip")
    )
    return _typed(counts, "card_counts")


# -- Reports over the logs ----------------------------------------------------


def _totals(rollup: DataFrame, *keys: str) -> DataFrame:
    """The rollup added up by fewer keys, peak and off-peak delays apart."""
    peak = F.col("is_peak_hour")
    parts = [f"{part}_{v}" for v in VALUES for part in ("sum", "n")]
    halves = {"peak": peak, "offpeak": ~peak}
    return rollup.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[or_zero(F.sum(F.when(on, F.col("n")))).alias(f"n_{h}") for h, on in halves.items()],
        *[F.sum(p).alias(p) for p in parts],
        *[
            F.sum(F.when(on, F.col(f"{part}_{v}"))).alias(f"{part}_{h}_{v}")
            for h, on in halves.items()
            for v in ("ride", "delay", "load")
            for part in ("sum", "n")
        ],
        F.sum("squares").alias("squares"),
        F.min("min_delay").alias("min_delay_min"),
        F.max("max_delay").alias("max_delay_min"),
        F.max("max_load").alias("max_passengers"),
    )


def _per_route(rollup: DataFrame) -> DataFrame:
    days = rollup.select("route_id", "log_date").distinct()
    tracked = days.groupBy("route_id").agg(F.count("log_date").alias("days_tracked"))
    return _totals(rollup, "route_id").join(tracked, "route_id")


@ordered("route_name", "route_id")
def route_summary(t: Tables) -> DataFrame:
    """Everything known about a route in one row."""
    loads = t.load_counts.groupBy("route_id", "passenger_count").agg(F.sum("n").alias("n"))
    return performance.summary_rows(
        t, _per_route(t.log_rollup), performance.crowded_rides(t, loads)
    )


@ordered("route_id")
def route_stats(t: Tables, route_id: int | None = None) -> DataFrame:
    """Key figures per route."""
    measures = _per_route(only(t.log_rollup, equals("route_id", route_id)))
    renamed = {
        f"{part}_{half}_delay": f"{part}_{half}"
        for half in ("peak", "offpeak")
        for part in ("sum", "n")
    }
    measures = measures.drop("n_peak", "n_offpeak").withColumnsRenamed(renamed)
    return performance.stats_rows(t, measures, route_id)


def travel_time_trends(
    t: Tables,
    route_id: int | None = None,
    days: int = 30,
    as_of: datetime | None = None,
    sort: bool = True,
) -> DataFrame:
    """Daily means since ``days`` before ``as_of``, of one route or of each."""
    recent = t.log_rollup.filter(F.col("log_date") >= first_day(as_of, days))
    keys = ["log_date"] if route_id is not None else ["route_id", "log_date"]
    trend = _totals(only(recent, equals("route_id", route_id)), *keys).select(
        *keys,
        rounded(mean_of("ride")).alias("avg_duration"),
        rounded(mean_of("delay")).alias("avg_delay"),
        rounded(mean_of("load")).alias("avg_passengers"),
        F.col("n").alias("trip_count"),
    )
    return trend.orderBy(*keys) if sort else trend


@ordered("-peak_delay", "route_name", "transport_type")
def peak_vs_offpeak(t: Tables) -> DataFrame:
    """Peak against off-peak means per route name and type."""
    names = {"duration": "ride", "delay": "delay", "passengers": "load"}
    return (
        route_identity(t)
        .join(_totals(t.log_rollup, "route_id"), "route_id")
        .groupBy("route_name", "transport_type")
        .agg(
            *[
                rounded(ratio(F.sum(f"sum_{half}_{v}"), F.sum(f"n_{half}_{v}"))).alias(
                    f"{half}_{name}"
                )
                for name, v in names.items()
                for half in ("peak", "offpeak")
            ]
        )
    )


@ordered("-avg_delay", "weather_condition")
def weather_impact(t: Tables, route_id: int | None = None) -> DataFrame:
    """Counts, means and the worst delay by weather."""
    rollup = only(t.log_rollup, equals("route_id", route_id))
    return _totals(rollup, "weather_condition").select(
        "weather_condition",
        F.col("n").alias("trip_count"),
        rounded(mean_of("ride")).alias("avg_duration"),
        rounded(mean_of("delay")).alias("avg_delay"),
        F.col("max_delay_min").alias("max_delay"),
    )


@ordered("-log_date", "route_name", "route_id")
def daily_metrics(t: Tables, modal_weather: bool = False) -> DataFrame:
    """Measures per day and route."""
    by_weather = _totals(t.log_rollup, "log_date", "route_id", "weather_condition")
    return performance.daily_rows(
        t, by_weather.withColumn("fullest", F.col("max_passengers")), modal_weather
    )


@ordered("hour_of_day", "route_name", "route_id", "is_peak_hour")
def hourly_patterns(t: Tables) -> DataFrame:
    """Measures per hour of the day, route and peak flag."""
    measures = _totals(t.log_rollup, "hour_of_day", "route_id", "is_peak_hour").select(
        "hour_of_day",
        "route_id",
        "is_peak_hour",
        F.col("n").alias("trip_count"),
        rounded(mean_of("ride")).alias("avg_duration"),
        rounded(mean_of("delay")).alias("avg_delay"),
        mean_of("load").alias("load"),
    )
    return performance.hourly_rows(t, measures)


@ordered("route_name", "-avg_delay", "route_id", "weather_condition")
def weather_by_route(t: Tables) -> DataFrame:
    """Measures per route and known kind of weather."""
    known = t.log_rollup.filter(F.col("weather_condition").isNotNull())
    measures = _totals(known, "route_id", "weather_condition").select(
        "route_id",
        "weather_condition",
        F.col("n").alias("trip_count"),
        rounded(mean_of("ride")).alias("avg_duration"),
        rounded(mean_of("delay")).alias("avg_delay"),
        deviation(F.col("n_delay"), F.col("sum_delay"), F.col("squares")).alias("delay_std_dev"),
        F.col("max_delay_min").alias("max_delay"),
        rounded(mean_of("load")).alias("avg_passengers"),
    )
    names = [c for c in measures.columns if c != "route_id"]
    return measures.join(route_identity(t), "route_id").select(
        "route_id", "route_name", "transport_type", *names
    )


# -- Reports over the trips ---------------------------------------------------


def _between(since: date | None, until: date | None) -> list[Column]:
    day = F.col("trip_date")
    bounds = []
    if since is not None:
        bounds.append(day >= F.lit(since))
    if until is not None:
        bounds.append(day <= F.lit(until))
    return bounds


def _riders(t: Tables, grain: str, key: str, *bounds: Column) -> DataFrame:
    """Distinct cards of each key: its words united, bucket by bucket, and counted."""
    sets = only(t.rider_sets.filter(F.col("grain") == grain), *bounds).select(
        F.col(key).alias("of"), "bucket", "cards"
    )
    united = dealt(sets, sets.count(), "of", "bucket").groupBy("of", "bucket").agg(
        F.bit_or("cards").alias("cards")
    )
    return united.groupBy("of").agg(F.sum(F.bit_count("cards")).alias("n_riders"))


def _ridden(t: Tables, key: str, grain: str, column: str, *bounds: Column) -> DataFrame:
    """Trips, fares and riders of each key."""
    sums = (
        only(t.trip_rollup, *bounds)
        .groupBy(key)
        .agg(*[F.sum(c).alias(c) for c in ("n", "sum_fare", "n_fare")])
    )
    riders = _riders(t, grain, column, *bounds)
    return sums.join(riders, F.col(key).eqNullSafe(F.col("of")), "left").select(
        key,
        "n",
        F.col("sum_fare").cast("decimal(20,2)").alias("total_revenue"),
        ratio(F.col("sum_fare"), F.col("n_fare")).alias("avg_fare"),
        or_zero(F.col("n_riders")).alias("n_riders"),
    )


@ordered("-trip_date")
def daily_ridership(
    t: Tables, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Trips, distinct riders and revenue per day, both ends of the range included."""
    found = _ridden(t, "trip_date", "day", "trip_date", *_between(since, until))
    return found.select(
        "trip_date",
        F.col("n").alias("total_trips"),
        F.col("n_riders").alias("unique_riders"),
        "total_revenue",
        "avg_fare",
    )


@ordered("route_id")
def route_performance(
    t: Tables, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Trips, revenue and riders per route in a range of days, idle routes included."""
    found = _ridden(t, "route_id", "route", "key", *_between(since, until))
    return (
        route_identity(t)
        .join(found, "route_id", "left")
        .select(
            "route_id",
            "route_name",
            "transport_type",
            or_zero(F.col("n")).alias("total_trips"),
            "total_revenue",
            "avg_fare",
            or_zero(F.col("n_riders")).alias("unique_riders"),
        )
    )


@ordered("hour")
def peak_hour_analysis(
    t: Tables, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Trips, mean fare and distinct riders per hour of tap-in in a range of days."""
    found = _ridden(t, "hour", "hour", "key", *_between(since, until))
    return found.select(
        "hour",
        F.col("n").alias("trip_count"),
        "avg_fare",
        F.col("n_riders").alias("unique_riders"),
    )


def card_statistics(t: Tables) -> DataFrame:
    """Trip count and last trip of each card; cards without trips keep theirs."""
    ridden = t.card_counts.groupBy("card_id").agg(
        F.sum("n").cast("int").alias("n_trips"), F.max("last_trip").alias("last_trip")
    )
    cards = t.fare_cards.select("card_id", "total_trips", "last_used")
    return cards.join(ridden, "card_id", "left").select(
        "card_id",
        F.coalesce("n_trips", "total_trips").alias("total_trips"),
        F.coalesce("last_trip", "last_used").alias("last_used"),
    )
