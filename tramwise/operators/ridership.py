"""Trips, riders, cards and revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import in_hours, is_weekend
from ..functions.labels import card_number, card_type
from ..functions.order import ordered
from ..functions.stats import count_rows, mean, or_zero
from ..schema import IMPORT_PEAK_HOURS
from ..sources.tables import Tables
from .common import route_identity


def fare() -> Column:
    return F.col("fare_paid")


@ordered("-trip_date")
def daily_ridership(t: Tables) -> DataFrame:
    """Trips, distinct riders and revenue per day."""
    return t.trips.groupBy("trip_date").agg(
        count_rows().alias("total_trips"),
        F.count_distinct("card_id").alias("unique_riders"),
        F.sum(fare()).alias("total_revenue"),
        mean(fare()).alias("avg_fare"),
    )


@ordered("route_id")
def route_performance(t: Tables) -> DataFrame:
    """Trips, revenue and riders per route, idle routes included."""
    ridden = t.trips.groupBy("route_id").agg(
        count_rows().alias("n_trips"),
        F.sum(fare()).alias("total_revenue"),
        mean(fare()).alias("avg_fare"),
        F.count_distinct("card_id").alias("n_riders"),
    )
    return (
        route_identity(t)
        .join(ridden, "route_id", "left")
        .select(
            "route_id",
            "route_name",
            "transport_type",
            or_zero(F.col("n_trips")).alias("total_trips"),
            "total_revenue",
            "avg_fare",
            or_zero(F.col("n_riders")).alias("unique_riders"),
        )
    )


@ordered("card_type")
def card_type_usage(t: Tables) -> DataFrame:
    """Cards, trips and revenue per card type; unused cards count as cards."""
    per_card = t.trips.groupBy("card_id").agg(
        count_rows().alias("n_trips"), F.sum(fare()).alias("revenue")
    )
    return (
        t.fare_cards.select("card_id", "card_type")
        .join(per_card, "card_id", "left")
        .groupBy("card_type")
        .agg(
            count_rows().alias("total_cards"),
            or_zero(F.sum("n_trips")).alias("total_trips"),
            F.sum("revenue").alias("total_revenue"),
        )
    )


@ordered("hour")
def peak_hour_analysis(t: Tables) -> DataFrame:
    """Trips, mean fare and distinct riders per hour of tap-in."""
    return t.trips.groupBy(F.hour("tap_in_time").alias("hour")).agg(
        count_rows().alias("trip_count"),
        mean(fare()).alias("avg_fare"),
        F.count_distinct("card_id").alias("unique_riders"),
    )


def card_statistics(t: Tables) -> DataFrame:
    """Trip count and last trip of each card; cards without trips keep theirs."""
    ridden = t.trips.groupBy("card_id").agg(
        count_rows().cast("int").alias("n_trips"), F.max("trip_date").alias("last_trip")
    )
    cards = t.fare_cards.select("card_id", "total_trips", "last_used")
    return cards.join(ridden, "card_id", "left").select(
        "card_id",
        F.coalesce("n_trips", "total_trips").alias("total_trips"),
        F.coalesce("last_trip", "last_used").alias("last_used"),
    )


def refreshed_fare_cards(t: Tables, statistics: DataFrame | None = None) -> DataFrame:
    """The next fare card snapshot, with the statistics brought up to date."""
    old = t.fare_cards
    found = card_statistics(t) if statistics is None else statistics
    return (
        old.drop("total_trips", "last_used")
        .join(found, "card_id", "left")
        .select(*old.columns)
    )


def fare_card_numbers(t: Tables) -> DataFrame:
    """Printed number and type that follow from the running card number."""
    number = F.col("card_id")
    return t.fare_cards.select(
        "card_id",
        card_number(number).alias("card_number"),
        card_type(number).alias("card_type"),
    )


def peak_flag(t: Tables, hours: tuple[int, ...] = IMPORT_PEAK_HOURS) -> DataFrame:
    """Whether each trip began in one of the peak hours."""
    flag = in_hours(F.col("tap_in_time"), hours)
    return t.trips.select("trip_id", "tap_in_time", flag.alias("is_peak_hour"))


@ordered("trip_date")
def weekend_flag(t: Tables) -> DataFrame:
    """Days with trips, marked as weekend or not, with their trip counts."""
    days = t.trips.groupBy("trip_date").agg(count_rows().alias("total_trips"))
    return days.select(
        "trip_date", is_weekend(F.col("trip_date")).alias("is_weekend"), "total_trips"
    )


@ordered("day")
def calendar(t: Tables) -> DataFrame:
    """Every day between the first and the last trip, gaps included."""
    span = t.trips.agg(
        F.min("trip_date").alias("first"), F.max("trip_date").alias("last")
    )
    return span.select(F.explode(F.sequence("first", "last")).alias("day"))
