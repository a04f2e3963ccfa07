"""Small literal tables to start or try a network with.

They serve tests and demonstrations; reports run on stored tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType, StructType

from ..schema import LAYOUTS, STOP_LISTS
from .tables import Tables

# --- fixed values: boroughs as zones (name, density, income, kind) -----------
BOROUGHS = (
    ("Manhattan", 300000.0, 120000.0, "Commercial"),
    ("Brooklyn", 150000.0, 65000.0, "Residential"),
    ("Queens", 100000.0, 70000.0, "Residential"),
    ("Bronx", 120000.0, 55000.0, "Residential"),
    ("Staten Island", 50000.0, 75000.0, "Residential"),
)

# --- fixed values: demonstration network -------------------------------------
DEMO_ZONES = (
    ("Downtown Core", 8500.5, 75000.0, "Commercial"),
    ("Business District", 6200.8, 82000.0, "Commercial"),
    ("Residential North", 4300.2, 58000.0, "Residential"),
    ("Residential South", 3900.5, 52000.0, "Residential"),
    ("Suburban East", 2100.3, 48000.0, "Residential"),
    ("Suburban West", 2400.7, 51000.0, "Residential"),
    ("Industrial Zone", 1800.2, 44000.0, "Industrial"),
    ("Tech Park", 3500.4, 95000.0, "Commercial"),
)
# name, zone, latitude, longitude, elevator, escalator, parking
DEMO_STATIONS = (
    ("Central Station", 1, "40.7580", "-73.9855", True, True, True),
    ("Business Plaza", 2, "40.7614", "-73.9776", True, True, False),
    ("North Park", 3, "40.7829", "-73.9654", True, True, True),
    ("South Gardens", 4, "40.7489", "-73.9680", True, False, True),
    ("East Terminal", 5, "40.7450", "-73.9320", True, False, True),
    ("West Junction", 6, "40.7590", "-74.0060", True, True, False),
    ("Industrial Hub", 7, "40.7320", "-73.9950", False, False, True),
    ("Tech Campus", 8, "40.7690", "-73.9550", True, True, False),
    ("Metro Central", 1, "40.7590", "-73.9845", True, True, False),
    ("Harbor Point", 4, "40.7410", "-73.9700", True, False, True),
    ("University Square", 3, "40.7780", "-73.9730", True, True, False),
    ("Airport Link", 5, "40.7480", "-73.9280", True, True, True),
)
# name, first and last station, kind, seats, accessible, km, fare
DEMO_ROUTES = (
    ("Express 1", 1, 8, "Metro", 200, True, "8.5", "3.50"),
    ("Express 2", 1, 5, "Metro", 200, True, "12.3", "4.00"),
    ("Local A", 3, 4, "Bus", 60, True, "5.2", "2.00"),
    ("Local B", 6, 2, "Bus", 60, True, "6.8", "2.50"),
    ("Rapid 5", 2, 8, "Metro", 180, True, "7.1", "3.25"),
    ("Shuttle X", 7, 1, "Bus", 40, False, "9.4", "2.75"),
    ("Green Line", 3, 11, "Tram", 120, True, "4.5", "2.25"),
    ("Blue Line", 9, 10, "Metro", 220, True, "6.7", "3.00"),
    ("Airport Express", 1, 12, "Metro", 150, True, "15.8", "5.50"),
    ("Campus Connect", 11, 8, "Bus", 50, True, "3.2", "1.75"),
)


def literal_table(spark: SparkSession, layout: str, columns: str, rows) -> DataFrame:
    """Inline rows for some columns of a layout, numbered from 1 in the first."""
    schema = StructType.fromDDL(layout)
    names = [schema.names[0], *columns.split()]
    decimals = {f.name for f in schema.fields if isinstance(f.dataType, DecimalType)}

    def filled(number: int, row: tuple) -> tuple:
        given = dict(zip(names, (number, *row), strict=True))
        return tuple(
            Decimal(given[n]) if n in decimals and n in given else given.get(n)
            for n in schema.names
        )

    return spark.createDataFrame(
        [filled(number, row) for number, row in enumerate(rows, 1)], schema
    )


def borough_zones(spark: SparkSession) -> DataFrame:
    columns = "zone_name population_density avg_income area_type"
    return literal_table(spark, LAYOUTS["zones"], columns, BOROUGHS)


def demo_network(spark: SparkSession) -> Tables:
    """Zones, stations and routes of the demonstration network."""
    return Tables(
        zones=literal_table(
            spark,
            LAYOUTS["zones"],
            "zone_name population_density avg_income area_type",
            DEMO_ZONES,
        ),
        stations=literal_table(
            spark,
            LAYOUTS["stations"],
            "station_name zone_id latitude longitude has_elevator has_escalator "
            "parking_available",
            DEMO_STATIONS,
        ),
        routes=literal_table(
            spark,
            LAYOUTS["routes"],
            "route_name start_station_id end_station_id transport_type max_capacity "
            "wheelchair_accessible distance_km base_fare",
            DEMO_ROUTES,
        ),
    )


def stop_lists(spark: SparkSession, lines) -> DataFrame:
    """Lines from ``(code, description, stops)``, numbered from 1."""
    rows = [(number, *line) for number, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, STOP_LISTS)
