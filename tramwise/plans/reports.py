"""All reports by name, for callers that pick one at run time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import (
    audit,
    capacity,
    overview,
    performance,
    ridership,
    routes,
    service,
    stations,
)
from ..sources.tables import Tables

_MODULES = {
    routes: (
        "all_routes",
        "filter_routes",
        "route_by_stations",
        "alternative_routes",
        "reachable_stations",
        "route_schedules",
        "schedule_preview",
        "route_lookup",
        "delay_traffic_light",
    ),
    performance: (
        "route_stats",
        "travel_time_trends",
        "peak_vs_offpeak",
        "weather_impact",
        "weather_share",
        "route_performance_export",
        "route_summary",
        "daily_metrics",
        "hourly_patterns",
        "weather_by_route",
    ),
    service: (
        "current_service_status",
        "service_status_categories",
        "status_summary",
        "status_board",
        "service_reliability",
        "reliability_ranking",
        "availability_summary",
    ),
    stations: ("all_stations", "station_details", "station_connectivity"),
    capacity: (
        "seats_available",
        "booking_list",
        "booking_status",
        "overloaded_services",
    ),
    ridership: (
        "daily_ridership",
        "route_performance",
        "card_type_usage",
        "peak_hour_analysis",
        "card_statistics",
        "fare_card_numbers",
        "peak_flag",
        "weekend_flag",
        "calendar",
    ),
    overview: ("system_kpis", "routes_by_type", "fare_histogram", "volume_summary"),
    audit: ("integrity_audit",),
}

REPORTS: dict[str, Callable[..., DataFrame]] = {
    name: getattr(module, name) for module, names in _MODULES.items() for name in names
}

# Reports that are also views, and the tables they read.
VIEWS = {
    "daily_ridership": ("trips",),
    "route_performance": ("routes", "trips"),
    "card_type_usage": ("fare_cards", "trips"),
    "peak_hour_analysis": ("trips",),
}


class Transit:
    """A set of tables with every report as a method.

    >>> Transit(tables).service_reliability(days=7)
    """

    def __init__(self, tables: Tables):
        self.tables = tables

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name not in REPORTS:
            raise AttributeError(f"no report named {name!r}")
        report = REPORTS[name]
        return lambda *args, **params: report(self.tables, *args, **params)

    def __dir__(self) -> list[str]:
        return sorted([*super().__dir__(), *REPORTS])

    def query(self, text: str, **args) -> DataFrame:
        """SQL over the tables, with ``:name`` markers for the arguments.

        The tables and the four summary views are visible under their names.
        """
        self.tables.register_views()
        for name in VIEWS:
            if all(table in self.tables.names() for table in VIEWS[name]):
                view = REPORTS[name](self.tables, sort=False)
                view.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)

    @property
    def spark(self) -> SparkSession:
        name = self.tables.names()[0]
        return getattr(self.tables, name).sparkSession

    def records(self, name: str, limit: int | None = None, **params) -> list[dict]:
        """The rows of a report as dictionaries, all of them or the first ``limit``."""
        return to_records(getattr(self, name)(**params), limit)


def to_records(frame: DataFrame, limit: int | None = None) -> list[dict]:
    """All rows, or the first ``limit``, as dictionaries on the driver.

    Rows come one partition after the other. For tables that do not fit there,
    write the frame or go through its ``toLocalIterator``.
    """
    if limit is not None:
        return [row.asDict() for row in frame.limit(limit).collect()]
    return [row.asDict() for row in frame.toLocalIterator()]


def first_record(frame: DataFrame) -> dict:
    """The first row, or an empty dictionary."""
    row = frame.first()
    return row.asDict() if row is not None else {}


@contextmanager
def kept(
    frame: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> Iterator[DataFrame]:
    """Hold a frame that several reports read, for the length of a block."""
    frame.persist(level)
    try:
        yield frame
    finally:
        frame.unpersist()
