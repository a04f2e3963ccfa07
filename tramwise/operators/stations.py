"""Stations and how well they are connected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordered
from ..functions.stats import count_rows, or_zero
from ..sources.tables import Tables
from .common import accessible_only, equals, only


def _with_connections(t: Tables, stations: DataFrame) -> DataFrame:
    """Add the numbers of routes that leave and reach each station.

    Each count is made on its own; joining both route sets first would pair
    every departure with every arrival.
    """
    for end, name in (("start", "outgoing_routes"), ("end", "incoming_routes")):
        counts = (
            t.routes.filter(F.col(f"{end}_station_id").isNotNull())
            .groupBy(F.col(f"{end}_station_id").alias("station_id"))
            .agg(count_rows().alias(name))
        )
        stations = stations.join(counts, "station_id", "left")
        stations = stations.withColumn(name, or_zero(F.col(name)))
    return stations


@ordered("station_name")
def all_stations(t: Tables, wheelchair_only: bool = False) -> DataFrame:
    stations = only(t.stations, accessible_only(wheelchair_only))
    return stations.select("station_name").distinct()


@ordered("station_name", "station_id")
def station_details(t: Tables, station_name: str | None = None) -> DataFrame:
    """Zone, features and connections of one station, or of all."""
    stations = only(t.stations, equals("station_name", station_name))
    zones = t.zones.select("zone_id", "zone_name")
    return _with_connections(t, stations.join(zones, "zone_id")).select(
        "station_id",
        "station_name",
        "zone_name",
        "wheelchair_accessible",
        "has_elevator",
        "outgoing_routes",
        "incoming_routes",
    )


@ordered("-total_connections", "station_name", "station_id")
def station_connectivity(t: Tables) -> DataFrame:
    """Every station with its zone's figures and its connections."""
    zones = t.zones.select("zone_id", "zone_name", "population_density", "avg_income")
    total = F.col("outgoing_routes") + F.col("incoming_routes")
    return _with_connections(t, t.stations.join(zones, "zone_id")).select(
        "station_id",
        "station_name",
        "zone_name",
        "population_density",
        "avg_income",
        "latitude",
        "longitude",
        "wheelchair_accessible",
        "has_elevator",
        "outgoing_routes",
        "incoming_routes",
        total.alias("total_connections"),
    )
