"""Landed raw files to stored tables.

Each table lands as Parquet or JSON lines in a folder of its own name. A load brings
the tables that are there; the others stay as they were published before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import rollup
from ..operators.ingest import conform, log_rows, schedule_rows, trip_rows
from ..operators.ridership import refreshed_fare_cards
from ..schema import LAYOUTS
from ..sources.tables import Tables

#: How rows of a table are completed; others are only cast to their layout.
COMPLETED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "schedules": schedule_rows,
    "travel_time_logs": log_rows,
    "trips": trip_rows,
}


def landed(
    spark: SparkSession, path: str, names: Iterable[str], form: str = "parquet"
) -> Tables:
    """The named tables from their folders under ``path``."""

    def table(name: str) -> DataFrame:
        reader = spark.read.format(form)
        if form != "parquet":
            reader = reader.schema(LAYOUTS[name])
        raw = reader.load(f"{path}/{name}")
        complete = COMPLETED.get(name)
        return complete(raw) if complete else conform(raw, name)

    return Tables(**{name: table(name) for name in names})


def with_card_statistics(stored: Tables) -> Tables:
    """The fare cards alone, with trip counts and last use from the trips.

    Where counts of cards are stored (see ``refresh.maintain``), trips counted before
    are not read again.
    """
    found = rollup.card_statistics(stored) if "card_counts" in stored.derived() else None
    return Tables(fare_cards=conform(refreshed_fare_cards(stored, found), "fare_cards"))
