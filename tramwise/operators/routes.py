"""Route catalogue, direct and one-transfer search, timetable views."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import clock, first_instant, weekday_rank
from ..functions.labels import traffic_light
from ..functions.order import ordered, rising, sort_columns
from ..functions.stats import at_least_one, count_rows, mean, or_zero, rounded
from ..schema import TRANSFER_MINUTES
from ..sources.tables import Tables
from .common import (
    delay,
    ride_minutes,
    accessible_only,
    equals,
    only,
    route_means,
    top_per_group,
    with_station_names,
)

ROUTE_COLUMNS = (
    "route_id",
    "route_name",
    "transport_type",
    "start_station",
    "end_station",
    "distance_km",
    "base_fare",
)


@ordered("route_name", "route_id")
def all_routes(t: Tables, wheelchair_only: bool = False) -> DataFrame:
    """Every route with its ends, mean ride time and mean delay.

    Routes that were never measured stay, with NULL means.
    """
    routes = only(t.routes, accessible_only(wheelchair_only))
    return (
        with_station_names(t, routes)
        .join(route_means(t.travel_time_logs), "route_id", "left")
        .select(
            *ROUTE_COLUMNS,
            "max_capacity",
            "wheelchair_accessible",
            "avg_travel_time_min",
            "avg_delay_min",
        )
    )


@ordered("route_name", "route_id")
def filter_routes(
    t: Tables,
    transport_types: Iterable[str] | None = None,
    max_travel_time: float | None = None,
    wheelchair_only: bool = False,
) -> DataFrame:
    """:func:`all_routes` narrowed to some transport types and a longest time."""
    routes = all_routes(t, wheelchair_only, sort=False)
    if transport_types is not None:
        routes = routes.filter(F.col("transport_type").isin(*transport_types))
    if max_travel_time is not None:
        routes = routes.filter(F.col("avg_travel_time_min") <= max_travel_time)
    return routes


@ordered("avg_travel_time_min", "route_id")
def route_by_stations(
    t: Tables,
    start: str | None = None,
    end: str | None = None,
    max_travel_time: float | None = None,
    wheelchair: bool = False,
    as_of: datetime | None = None,
) -> DataFrame:
    """Direct routes between two named stations (``None``: any station).

    ``active_services`` and ``delayed_services`` count the checks of the last
    seven days once per log row, as the joined form does; ``active_checks`` and
    ``delayed_checks`` count each check once. The longest time is compared with
    the mean before rounding and drops unmeasured routes.
    """
    routes = only(
        with_station_names(t, only(t.routes, accessible_only(wheelchair))),
        equals("start_station", start),
        equals("end_station", end),
    )
    logs, all_checks = t.travel_time_logs, t.service_availability
    if start is not None or end is not None:
        # A search for a few routes leaves the facts of all others unread or unsummed.
        wanted = routes.select("route_id")
        logs = logs.join(wanted, "route_id", "left_semi")
        all_checks = all_checks.join(wanted, "route_id", "left_semi")
    measured = logs.groupBy("route_id").agg(
        mean(ride_minutes()).alias("mean_time"),
        mean(delay()).alias("mean_delay"),
        count_rows().alias("n_logs"),
    )
    recent = all_checks.filter(
        F.col("check_time") >= first_instant(as_of, days=7)
    )
    checks = recent.groupBy("route_id").agg(
        F.count_if("is_operational").alias("n_active"),
        F.count_if(~F.col("is_operational")).alias("n_delayed"),
    )
    joined = routes.join(measured, "route_id", "left").join(checks, "route_id", "left")
    if max_travel_time is not None:
        joined = joined.filter(F.col("mean_time") <= max_travel_time)
    active, delayed = or_zero(F.col("n_active")), or_zero(F.col("n_delayed"))
    repeats = at_least_one(or_zero(F.col("n_logs")))
    return joined.select(
        *ROUTE_COLUMNS,
        "wheelchair_accessible",
        rounded(F.col("mean_time")).alias("avg_travel_time_min"),
        rounded(F.col("mean_delay")).alias("avg_delay_min"),
        (active * repeats).alias("active_services"),
        (delayed * repeats).alias("delayed_services"),
        active.alias("active_checks"),
        delayed.alias("delayed_checks"),
    )


@ordered("total_travel_time_min", "route1_name", "route2_name")
def alternative_routes(
    t: Tables, start: str, end: str, wheelchair: bool = False
) -> DataFrame:
    """Journeys with exactly one transfer between two named stations.

    The station names narrow both legs before they meet at the transfer
    station; the means are joined to the found pairs only. A leg that was never
    measured makes the total time and delay NULL.
    """
    routes = with_station_names(t, only(t.routes, accessible_only(wheelchair)))
    first = _leg(routes.filter(F.col("start_station") == start), 1)
    second = _leg(routes.filter(F.col("end_station") == end), 2)
    meet = (F.col("to1") == F.col("from2")) & (F.col("id1") != F.col("id2"))
    pairs = first.join(second, meet)
    legs = pairs.select(F.explode(F.array("id1", "id2")).alias("route_id")).distinct()
    means = route_means(t.travel_time_logs.join(legs, "route_id", "left_semi"))
    for n in (1, 2):
        leg_means = means.select(
            F.col("route_id").alias(f"id{n}"),
            F.col("avg_travel_time_min").alias(f"time{n}"),
            F.col("avg_delay_min").alias(f"delay{n}"),
        )
        pairs = pairs.join(leg_means, f"id{n}", "left")
    return pairs.select(
        "route1_name",
        "transport1_type",
        F.col("start1").alias("start_station"),
        F.col("end1").alias("transfer_station"),
        "distance1_km",
        "fare1",
        "route2_name",
        "transport2_type",
        F.col("end2").alias("end_station"),
        "distance2_km",
        "fare2",
        (F.col("distance1_km") + F.col("distance2_km")).alias("total_distance_km"),
        (F.col("fare1") + F.col("fare2")).alias("total_fare"),
        (F.col("time1") + F.col("time2") + TRANSFER_MINUTES).alias(
            "total_travel_time_min"
        ),
        (F.col("delay1") + F.col("delay2")).alias("total_delay_min"),
        (F.col("accessible1") & F.col("accessible2")).alias("wheelchair_accessible"),
    )


def _leg(routes: DataFrame, n: int) -> DataFrame:
    return routes.select(
        F.col("route_id").alias(f"id{n}"),
        F.col("start_station_id").alias(f"from{n}"),
        F.col("end_station_id").alias(f"to{n}"),
        F.col("route_name").alias(f"route{n}_name"),
        F.col("transport_type").alias(f"transport{n}_type"),
        F.col("start_station").alias(f"start{n}"),
        F.col("end_station").alias(f"end{n}"),
        F.col("distance_km").alias(f"distance{n}_km"),
        F.col("base_fare").alias(f"fare{n}"),
        F.col("wheelchair_accessible").alias(f"accessible{n}"),
    )


def reachable_stations(
    t: Tables, start: str | None = None, wheelchair: bool = False, sort: bool = True
) -> DataFrame:
    """Stations one ride away; for ``None``, from every start station."""
    routes = with_station_names(t, only(t.routes, accessible_only(wheelchair)))
    found = only(routes, equals("start_station", start)).select(
        "start_station", F.col("end_station").alias("station_name")
    )
    keys = ("start_station", "station_name")
    if start is not None:
        found, keys = found.drop("start_station"), ("station_name",)
    found = found.distinct()
    return found.orderBy(*sort_columns(keys)) if sort else found


def route_schedules(
    t: Tables, route_id: int | None = None, limit: int = 10, sort: bool = True
) -> DataFrame:
    """First departures of the week, Monday first; unknown days come last.

    With ``None`` every route gets its own ``limit`` rows and ``route_id`` is
    part of the result.
    """
    order = [
        weekday_rank(F.col("day_of_week")).asc_nulls_last(),
        rising("departure_min"),
        rising("arrival_min"),
        rising("is_peak_hour"),
        rising("day_of_week"),
    ]
    columns = [
        F.col("day_of_week").alias("day"),
        clock(F.col("departure_min")).alias("departure_time"),
        clock(F.col("arrival_min")).alias("arrival_time"),
        "is_peak_hour",
        (F.col("arrival_min") - F.col("departure_min")).alias("duration_min"),
    ]
    if route_id is not None:
        rows = t.schedules.filter(F.col("route_id") == route_id)
        return rows.orderBy(*order).limit(limit).select(*columns)
    rows = top_per_group(t.schedules, ["route_id"], order, limit)
    if sort:
        rows = rows.orderBy(rising("route_id"), *order)
    return rows.select("route_id", *columns)


def schedule_preview(t: Tables, limit: int = 20, sort: bool = True) -> DataFrame:
    """The timetable excerpt shown for each listed route."""
    return route_schedules(t, None, limit, sort)


def route_lookup(
    t: Tables, route_name: str | None = None, sort: bool = True
) -> DataFrame:
    """Lowest route id of a listed name; for ``None``, of every name, by name.

    Listed are the routes of :func:`all_routes`, those with known stations.
    """
    routes = with_station_names(t, only(t.routes, equals("route_name", route_name)))
    found = routes.groupBy("route_name").agg(F.min("route_id").alias("route_id"))
    found = found.select("route_id", "route_name")
    return found.orderBy(rising("route_name")) if sort else found


@ordered("route_id")
def delay_traffic_light(t: Tables, wheelchair_only: bool = False) -> DataFrame:
    """Green below 5 minutes of mean delay, yellow below 10, else red."""
    return all_routes(t, wheelchair_only, sort=False).select(
        "route_id",
        "avg_delay_min",
        traffic_light(F.col("avg_delay_min")).alias("light"),
    )
