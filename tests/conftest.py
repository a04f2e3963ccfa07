import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tramwise.schema import LAYOUTS  # noqa: E402
from tramwise.session import configure  # noqa: E402
from tramwise.sources import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session, shuffle_partitions=4)
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build tables from lists of dictionaries; absent columns are NULL."""

    def build(**rows) -> Tables:
        frames = {}
        for name, given in rows.items():
            schema = spark.createDataFrame([], LAYOUTS[name]).schema
            filled = [tuple(row.get(f) for f in schema.names) for row in given]
            frames[name] = spark.createDataFrame(filled, schema)
        return Tables(**frames)

    return build


@pytest.fixture(scope="session")
def network(make):
    """Three stations in two zones, three routes."""
    from decimal import Decimal

    def route(number, name, kind, start, end, capacity, accessible=True, fare="2.00"):
        return {
            "route_id": number,
            "route_name": name,
            "transport_type": kind,
            "start_station_id": start,
            "end_station_id": end,
            "distance_km": Decimal("5.50"),
            "base_fare": Decimal(fare),
            "wheelchair_accessible": accessible,
            "max_capacity": capacity,
            "active": True,
        }

    return make(
        zones=[
            {"zone_id": 1, "zone_name": "North", "population_density": 10.0},
            {"zone_id": 2, "zone_name": "South", "population_density": 20.0},
        ],
        stations=[
            {"station_id": 1, "station_name": "A", "zone_id": 1},
            {"station_id": 2, "station_name": "B", "zone_id": 1},
            {"station_id": 3, "station_name": "C", "zone_id": 2},
        ],
        routes=[
            route(1, "one", "Bus", 1, 2, 60),
            route(2, "two", "Metro", 2, 3, 200, accessible=False, fare="3.00"),
            route(3, "loop", "Tram", 2, 2, 0),
        ],
    )


def log(route, delay=0, minute=480, day=date(2000, 1, 3), **more):
    from decimal import Decimal

    more["avg_travel_time"] = Decimal(str(more.get("avg_travel_time", "20.00")))
    return {
        "log_id": 1,
        "route_id": route,
        "log_date": day,
        "log_min": minute,
        "scheduled_duration_minutes": Decimal("18.00"),
        "passenger_count": 30,
        "is_peak_hour": True,
        "weather_condition": "Clear",
        "delay_minutes": delay,
        **more,
    }


def check(number, route, at="2000-01-03 08:10:00", ok=True, delay=0, reason=None):
    return {
        "availability_id": number,
        "route_id": route,
        "check_time": datetime.fromisoformat(at),
        "is_operational": ok,
        "delay_minutes": delay,
        "reason": reason,
    }


def rows(frame):
    return [row.asDict() for row in frame.collect()]
