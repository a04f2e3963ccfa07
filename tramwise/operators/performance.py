"""Ride time, delay, load and weather measures from the travel-time logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import first_day, hour_of_minute, sunday_based_weekday
from ..functions.labels import delay_category
from ..functions.order import ordered
from ..functions.stats import (
    count_rows,
    deviation,
    mean,
    minutes,
    or_zero,
    ratio,
    rounded,
    rounded_deviation,
    rounded_mean,
    rounded_mean_if,
    share_of_capacity,
    sum_of_squares,
)
from ..sources.tables import Tables
from .common import (
    delay,
    ride_minutes,
    passengers,
    in_peak,
    equals,
    only,
    route_identity,
    with_station_names,
)


#: What a log and a status check of the same hour agree in.
IN_HOUR = ("route_id", "log_date", "hour_of_day")


def _per_route(logs: DataFrame, means: dict[str, Column], *totals: tuple) -> DataFrame:
    """Means, totals and the days with logs of every route, in one scan.

    Logs are summed by route and day, then by route, where counting days is counting
    rows. On files laid out by date a task has few days, so that little is shuffled.
    ``totals`` are (name, measure per day, function over the days). Means are left
    as exact sums and counts: ``sum_<name>`` and ``n_<name>``.
    """
    daily = logs.groupBy("route_id", "log_date").agg(
        *[F.sum(v).alias(f"sum_{n}") for n, v in means.items()],
        *[F.count(v).alias(f"n_{n}") for n, v in means.items()],
        *[measure.alias(name) for name, measure, _ in totals],
    )
    return daily.groupBy("route_id").agg(
        F.count("log_date").alias("days_tracked"),
        *[F.sum(f"{part}_{n}").alias(f"{part}_{n}") for n in means for part in ("sum", "n")],
        *[over(name).alias(name) for name, _, over in totals],
    )


def mean_of(name: str) -> Column:
    return ratio(F.col(f"sum_{name}"), F.col(f"n_{name}"))


@ordered("route_id")
def route_stats(t: Tables, route_id: int | None = None) -> DataFrame:
    """Key figures per route; one call serves a single route or all of them."""
    wanted = equals("route_id", route_id)
    logs = only(t.travel_time_logs, wanted)
    measures = _per_route(
        logs,
        {
            "ride": ride_minutes(),
            "delay": delay(),
            "peak": F.when(in_peak(), delay()),
            "offpeak": F.when(~in_peak(), delay()),
            "load": passengers(),
        },
        ("max_delay_min", F.max(delay()), F.max),
    )
    return stats_rows(t, measures, route_id)


def stats_rows(t: Tables, measures: DataFrame, route_id: int | None) -> DataFrame:
    """Key figures from the sums of each route."""
    routes = only(
        route_identity(t, "distance_km", "max_capacity"), equals("route_id", route_id)
    )
    found = routes.join(measures, "route_id", "left")
    return found.select(
        *routes.columns,
        or_zero(F.col("days_tracked")).alias("days_tracked"),
        rounded(mean_of("ride")).alias("avg_duration_min"),
        rounded(mean_of("delay")).alias("avg_delay_min"),
        rounded(mean_of("peak")).alias("peak_delay_min"),
        rounded(mean_of("offpeak")).alias("offpeak_delay_min"),
        "max_delay_min",
        rounded(mean_of("load")).alias("avg_passengers"),
        share_of_capacity(mean_of("load"), F.col("max_capacity")).alias(
            "utilization_percent"
        ),
    )


def travel_time_trends(
    t: Tables,
    route_id: int | None = None,
    days: int = 30,
    as_of: datetime | None = None,
    sort: bool = True,
) -> DataFrame:
    """Daily means since ``days`` before ``as_of``.

    With ``None`` the trend of every route comes at once, with its
    ``route_id``.
    """
    recent = t.travel_time_logs.filter(F.col("log_date") >= first_day(as_of, days))
    keys = ["log_date"] if route_id is not None else ["route_id", "log_date"]
    trend = (
        only(recent, equals("route_id", route_id))
        .groupBy(*keys)
        .agg(
            rounded_mean(ride_minutes()).alias("avg_duration"),
            rounded_mean(delay()).alias("avg_delay"),
            rounded_mean(passengers()).alias("avg_passengers"),
            count_rows().alias("trip_count"),
        )
    )
    return trend.orderBy(*keys) if sort else trend


@ordered("-peak_delay", "route_name", "transport_type")
def peak_vs_offpeak(t: Tables) -> DataFrame:
    """Peak against off-peak means per route name and type.

    Logs are summed per route id first; the exact sums of routes that share a
    name are then added up.
    """
    halves = {"peak": in_peak(), "offpeak": ~in_peak()}
    values = {"duration": ride_minutes(), "delay": delay(), "passengers": passengers()}
    cells = [
        (f"{half}_{what}", F.when(condition, value))
        for what, value in values.items()
        for half, condition in halves.items()
    ]
    sums = [F.sum(v).alias(f"sum_{name}") for name, v in cells]
    counts = [F.count(v).alias(f"n_{name}") for name, v in cells]
    per_route = t.travel_time_logs.groupBy("route_id").agg(*sums, *counts)
    return (
        route_identity(t)
        .join(per_route, "route_id")
        .groupBy("route_name", "transport_type")
        .agg(
            *[
                rounded(ratio(F.sum(f"sum_{name}"), F.sum(f"n_{name}"))).alias(name)
                for name, _ in cells
            ]
        )
    )


@ordered("-avg_delay", "weather_condition")
def weather_impact(t: Tables, route_id: int | None = None) -> DataFrame:
    """Counts, means and the worst delay by weather; unknown weather is a group."""
    return (
        only(t.travel_time_logs, equals("route_id", route_id))
        .groupBy("weather_condition")
        .agg(
            count_rows().alias("trip_count"),
            rounded_mean(ride_minutes()).alias("avg_duration"),
            rounded_mean(delay()).alias("avg_delay"),
            F.max(delay()).alias("max_delay"),
        )
    )


@ordered("-trip_count", "weather_condition")
def weather_share(t: Tables, route_id: int | None = None) -> DataFrame:
    """Share of the logged trips that fell into each kind of weather."""
    logs = only(t.travel_time_logs, equals("route_id", route_id))
    counts = logs.groupBy("weather_condition").agg(count_rows().alias("trip_count"))
    # The total comes from the few counts, whose exchange serves both.
    total = counts.agg(F.sum("trip_count")).scalar()
    return counts.withColumn("share", ratio(F.col("trip_count"), total))


@ordered("-log_date", "-log_min", "route_id", "log_id")
def _newest_first(rows: DataFrame) -> DataFrame:
    return rows


def route_performance_export(t: Tables, sort: bool = False) -> DataFrame:
    """One wide row per log and per status check in the log's hour.

    Both facts are joined on (route, date, hour), a key that spreads a crowded
    route over its hours; what stays heavy is split by adaptive skew joins. The
    names come last, so that they are not shuffled with every log. ``sort=True`` puts
    the newest first, at the price of a range shuffle of every wide row.
    """
    return wide_rows(t, hourly_logs(t), hourly_checks(t), sort)


def hourly_logs(t: Tables) -> DataFrame:
    """The logs with the hour that their status checks share."""
    return t.travel_time_logs.withColumn("hour_of_day", hour_of_minute(F.col("log_min")))


def hourly_checks(t: Tables) -> DataFrame:
    """The status checks by route, date and hour."""
    return t.service_availability.select(
        "route_id",
        F.to_date("check_time").alias("log_date"),
        F.hour("check_time").alias("hour_of_day"),
        F.col("is_operational").alias("service_status"),
        F.col("delay_minutes").alias("service_delay_minutes"),
        F.col("reason").alias("service_issue_reason"),
    )


def wide_rows(t: Tables, logs: DataFrame, checks: DataFrame, sort: bool) -> DataFrame:
    """The wide export from logs and checks that have the columns of ``IN_HOUR``."""
    rows = logs.join(checks, list(IN_HOUR), "left").join(t.routes.drop("active"), "route_id")
    rows = with_station_names(t, rows, zones=True)
    if sort:
        rows = _newest_first(rows)
    return rows.select(
        "log_id",
        "log_date",
        F.col("log_min").alias("log_time"),
        sunday_based_weekday(F.col("log_date")).alias("day_of_week"),
        "hour_of_day",
        "route_id",
        "route_name",
        "transport_type",
        "start_station",
        "end_station",
        "start_zone_id",
        "start_zone",
        "end_zone_id",
        "end_zone",
        "distance_km",
        "base_fare",
        "max_capacity",
        "wheelchair_accessible",
        "scheduled_duration_minutes",
        "avg_travel_time",
        "delay_minutes",
        "passenger_count",
        share_of_capacity(passengers(), F.col("max_capacity")).alias(
            "capacity_utilization_percent"
        ),
        "weather_condition",
        "is_peak_hour",
        delay_category(delay()).alias("delay_category"),
        "service_status",
        "service_delay_minutes",
        "service_issue_reason",
    )


@ordered("route_name", "route_id")
def route_summary(t: Tables) -> DataFrame:
    """Everything known about a route in one row.

    Near-capacity rides depend on the route's capacity. Instead of joining each
    log to its route, the logs are counted by (route, load) and the few counts
    are compared with the capacity.
    """
    measures = _per_route(
        t.travel_time_logs,
        {
            "ride": ride_minutes(),
            "planned": minutes("scheduled_duration_minutes"),
            "delay": delay(),
            "load": passengers(),
        },
        ("squares", sum_of_squares(delay()), F.sum),
        ("max_delay_min", F.max(delay()), F.max),
        ("min_delay_min", F.min(delay()), F.min),
        ("max_passengers", F.max(passengers()), F.max),
        ("n_peak", F.count_if(in_peak()), F.sum),
        ("n_offpeak", F.count_if(~in_peak()), F.sum),
    )
    loads = t.travel_time_logs.groupBy("route_id", "passenger_count").agg(
        count_rows().alias("n")
    )
    crowded = crowded_rides(t, loads)
    return summary_rows(t, measures, crowded)


def crowded_rides(t: Tables, loads: DataFrame) -> DataFrame:
    """Rides at 90 % of the route's capacity or more, from counts by route and load."""
    return (
        loads.join(t.routes.select("route_id", "max_capacity"), "route_id")
        .filter(passengers().cast("bigint") * 10 >= F.col("max_capacity") * 9)
        .groupBy("route_id")
        .agg(F.sum("n").alias("n_crowded"))
    )


def summary_rows(t: Tables, measures: DataFrame, crowded: DataFrame) -> DataFrame:
    """The summary from the sums and the number of crowded rides of each route."""
    routes = with_station_names(t, t.routes, zones=True)
    return (
        routes.join(measures, "route_id", "left")
        .join(crowded, "route_id", "left")
        .select(
            "route_id",
            "route_name",
            "transport_type",
            "start_station",
            "end_station",
            "start_zone",
            "end_zone",
            "distance_km",
            "base_fare",
            "max_capacity",
            "wheelchair_accessible",
            or_zero(F.col("days_tracked")).alias("days_with_data"),
            rounded(mean_of("ride")).alias("avg_duration_min"),
            rounded(mean_of("planned")).alias("scheduled_duration_min"),
            rounded(mean_of("delay")).alias("avg_delay_min"),
            deviation(F.col("n_delay"), F.col("sum_delay"), F.col("squares")).alias(
                "delay_std_dev"
            ),
            "max_delay_min",
            "min_delay_min",
            rounded(mean_of("load")).alias("avg_passengers"),
            share_of_capacity(mean_of("load"), F.col("max_capacity")).alias(
                "avg_utilization_percent"
            ),
            "max_passengers",
            or_zero(F.col("n_crowded")).alias("near_capacity_trips"),
            or_zero(F.col("n_peak")).alias("peak_hour_trips"),
            or_zero(F.col("n_offpeak")).alias("offpeak_trips"),
        )
    )


@ordered("-log_date", "route_name", "route_id")
def daily_metrics(t: Tables, modal_weather: bool = False) -> DataFrame:
    """Measures per day and route.

    ``predominant_weather`` is the alphabetically last condition of the day;
    ``modal_weather=True`` adds the most frequent one as well.

    The largest text cannot be kept in a hash aggregate, which would make Spark
    sort all logs. So weather is a grouping key at first, and the largest is
    taken from the few groups of each day.
    """
    values = {
        "ride": ride_minutes(),
        "delay": delay(),
        "peak_delay": F.when(in_peak(), delay()),
        "offpeak_delay": F.when(~in_peak(), delay()),
        "load": passengers(),
    }
    by_weather = t.travel_time_logs.groupBy("log_date", "route_id", "weather_condition").agg(
        count_rows().alias("n"),
        F.count_if(in_peak()).alias("n_peak"),
        F.max(passengers()).alias("fullest"),
        *[F.sum(v).alias(f"sum_{name}") for name, v in values.items()],
        *[F.count(v).alias(f"n_{name}") for name, v in values.items()],
    )

    return daily_rows(t, by_weather, modal_weather)


def daily_rows(t: Tables, by_weather: DataFrame, modal_weather: bool) -> DataFrame:
    """The measures of days and routes from their sums by weather."""
    day_and_route = ("log_date", "route_id")

    def day_mean(name: str) -> Column:
        return rounded(ratio(F.sum(f"sum_{name}"), F.sum(f"n_{name}")))

    weather = F.col("weather_condition")
    most_often = F.when(weather.isNotNull(), F.struct("n", weather))
    modal = [F.max(most_often)["weather_condition"].alias("modal_weather")]
    measures = by_weather.groupBy(*day_and_route).agg(
        F.sum("n").alias("total_trips"),
        F.sum("n_peak").alias("peak_trips"),
        day_mean("ride").alias("avg_duration"),
        day_mean("delay").alias("avg_delay"),
        day_mean("peak_delay").alias("peak_delay"),
        day_mean("offpeak_delay").alias("offpeak_delay"),
        day_mean("load").alias("avg_passengers"),
        F.max("fullest").alias("max_passengers"),
        F.sum("sum_load").alias("total_passengers"),
        F.max(weather).alias("predominant_weather"),
        *(modal if modal_weather else []),
    )
    day = F.col("log_date")
    names = [c for c in measures.columns if c not in day_and_route]
    return measures.join(route_identity(t), "route_id").select(
        "log_date",
        sunday_based_weekday(day).alias("day_of_week"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.day(day).alias("day"),
        "route_id",
        "route_name",
        "transport_type",
        *names,
    )


@ordered("hour_of_day", "route_name", "route_id", "is_peak_hour")
def hourly_patterns(t: Tables) -> DataFrame:
    """Measures per hour of the day, route and peak flag."""
    measures = (
        t.travel_time_logs.groupBy(
            hour_of_minute(F.col("log_min")).alias("hour_of_day"),
            "route_id",
            "is_peak_hour",
        )
        .agg(
            count_rows().alias("trip_count"),
            rounded_mean(ride_minutes()).alias("avg_duration"),
            rounded_mean(delay()).alias("avg_delay"),
            mean(passengers()).alias("load"),
        )
    )
    return hourly_rows(t, measures)


def hourly_rows(t: Tables, measures: DataFrame) -> DataFrame:
    """Measures of hours with the names of their routes; ``load`` is unrounded."""
    return measures.join(route_identity(t, "max_capacity"), "route_id").select(
        "hour_of_day",
        "route_id",
        "route_name",
        "transport_type",
        "is_peak_hour",
        "trip_count",
        "avg_duration",
        "avg_delay",
        rounded(F.col("load")).alias("avg_passengers"),
        share_of_capacity(F.col("load"), F.col("max_capacity")).alias(
            "avg_utilization"
        ),
    )


@ordered("route_name", "-avg_delay", "route_id", "weather_condition")
def weather_by_route(t: Tables) -> DataFrame:
    """Measures per route and known kind of weather."""
    measures = (
        t.travel_time_logs.filter(F.col("weather_condition").isNotNull())
        .groupBy("route_id", "weather_condition")
        .agg(
            count_rows().alias("trip_count"),
            rounded_mean(ride_minutes()).alias("avg_duration"),
            rounded_mean(delay()).alias("avg_delay"),
            rounded_deviation(delay()).alias("delay_std_dev"),
            F.max(delay()).alias("max_delay"),
            rounded_mean(passengers()).alias("avg_passengers"),
        )
    )
    names = [c for c in measures.columns if c != "route_id"]
    return measures.join(route_identity(t), "route_id").select(
        "route_id", "route_name", "transport_type", *names
    )
