"""Bookings against the seats of a service.

The literal results count a passenger log once per booking at the same instant
and the other way round, as joining both sides does. Each side is aggregated on
its own and the row counts multiplied, so no joined rows are ever made;
``exact=True`` leaves the multiplication out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import instant
from ..functions.labels import booking_message
from ..functions.order import ordered
from ..functions.stats import at_least_one, count_rows, or_zero
from ..sources.tables import Tables
from .common import dealt, equals, only


def _load(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(
        F.sum("passenger_count").alias("passengers"), count_rows().alias("n_logs")
    )


def _booked(bookings: DataFrame, *keys: str) -> DataFrame:
    return bookings.groupBy(*keys).agg(F.count("booking_id").alias("n_bookings"))


def _repeated(value: Column, n: Column, exact: bool) -> Column:
    return value if exact else value * at_least_one(n)


@ordered("route_name", "seats_available")
def seats_available(
    t: Tables, at: datetime, route_name: str | None = None, exact: bool = False
) -> DataFrame:
    """Seats left at an instant; for ``None``, on every route."""
    now = F.col("ts") == instant(at)
    passengers, n_logs = or_zero(F.col("passengers")), or_zero(F.col("n_logs"))
    n_bookings = or_zero(F.col("n_bookings"))
    return (
        only(t.transport_routes, equals("route_name", route_name))
        .join(_load(t.passenger_logs.filter(now), "route_id"), "route_id", "left")
        .join(_booked(t.bookings.filter(now), "route_id"), "route_id", "left")
        .groupBy("route_name", "max_capacity")
        .agg(
            F.sum(_repeated(passengers, n_bookings, exact)).alias("taken"),
            F.sum(_repeated(n_bookings, n_logs, exact)).alias("booked"),
        )
        .select(
            "route_name",
            (F.col("max_capacity") - F.col("taken") - F.col("booked")).alias(
                "seats_available"
            ),
        )
    )


@ordered("timestamp", "booking_id")
def booking_list(t: Tables) -> DataFrame:
    """Bookings with the names of rider and route, in time order."""
    routes = t.transport_routes.select("route_id", "route_name")
    return (
        t.bookings.join(routes, "route_id")
        .join(t.users, "user_id")
        .select("booking_id", "name", "route_name", F.col("ts").alias("timestamp"))
    )


def booking_status(
    t: Tables, at: datetime, route_id: int | None = None, sort: bool = True
) -> DataFrame:
    """Whether a seat can still be booked; routes without bookings give no row.

    For ``None`` every booked route is answered, with its id and name.
    """
    at_instant = t.bookings.filter(F.col("ts") == instant(at))
    booked = _booked(only(at_instant, equals("route_id", route_id)), "route_id")
    left = F.col("max_capacity") - F.col("n_bookings")
    answer = booking_message(left).alias("booking_status")
    found = booked.join(t.transport_routes, "route_id")
    if route_id is not None:
        return found.select(answer)
    found = found.select("route_id", "route_name", answer)
    return found.orderBy("route_id") if sort else found


@ordered("route_name", "timestamp", "max_capacity")
def overloaded_services(t: Tables, exact: bool = False) -> DataFrame:
    """Services that carry more passengers and bookings than they have seats."""
    keys = ("route_id", "ts")
    n_bookings = or_zero(F.col("n_bookings"))
    per_log = F.lit(1) if exact else F.col("n_logs")
    # Services are nearly as many as logs. Both sides have the same parts, for the join.
    n_rows = max(t.passenger_logs.count(), t.bookings.count())
    logs = dealt(t.passenger_logs.select(*keys, "passenger_count"), n_rows, *keys)
    bookings = dealt(t.bookings.select(*keys, "booking_id"), n_rows, *keys)
    demand = (
        _load(logs, *keys)
        .join(_booked(bookings, *keys), list(keys), "left")
        .select(
            *keys,
            _repeated(F.col("passengers"), n_bookings, exact).alias("passengers"),
            (n_bookings * per_log).alias("bookings"),
        )
    )
    total = F.col("passengers") + F.col("bookings")
    service = ("route_name", "timestamp", "max_capacity")
    of_routes = demand.join(t.transport_routes, "route_id").withColumnRenamed("ts", "timestamp")
    return (
        dealt(of_routes.select(*service, "passengers", "bookings"), n_rows, *service)
        .groupBy(*service)
        .agg(
            F.sum("passengers").alias("passengers"),
            F.sum("bookings").alias("bookings"),
        )
        .filter(total > F.col("max_capacity"))
        .select(
            "route_name",
            "timestamp",
            total.alias("total_passengers"),
            "max_capacity",
            (F.col("max_capacity") - total).alias("available_seats"),
        )
    )
