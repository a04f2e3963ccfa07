"""From a raw feed and stop lists to a loaded network."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.ingest import (
    conform,
    distinct_stations,
    import_stations,
    routes_from_stop_lists,
    sound_rows,
    stable_keys,
    station_keys,
    stratified_sample,
)
from ..operators.timetable import timetable_importer
from ..sources.tables import Tables
from .refresh import parts, current, refresh

KEYS = ("station_keys", "route_keys")


def import_network(
    feed: DataFrame,
    lines: DataFrame,
    zones: DataFrame,
    sample: int | None = None,
    known: Tables | None = None,
) -> Tables:
    """Zones, stations, routes and timetable, and the keys of stations and routes.

    ``sample`` loads so many stations of each borough instead of all of the feed.
    ``known`` has the ``station_keys`` and ``route_keys`` of earlier loads: their
    stations and routes keep their numbers.
    """
    held = known.derived() if known is not None else {}
    if sample is not None:
        feed = stratified_sample(distinct_stations(sound_rows(feed)), sample)
    stops = station_keys(feed, held.get("station_keys"))
    stations = conform(import_stations(feed, zones, stops), "stations")
    found = routes_from_stop_lists(lines, stations)
    numbers = stable_keys(found, "line_id", "route_id", held.get("route_keys"))
    routes = conform(found.join(numbers, "line_id"), "routes")
    schedules = timetable_importer(routes.select("route_id"))
    return Tables(
        zones=zones,
        stations=stations,
        routes=routes,
        schedules=schedules,
        station_keys=stops,
        route_keys=numbers,
    )


def load_network(
    feed: DataFrame,
    lines: DataFrame,
    zones: DataFrame,
    base: str,
    stamp: str,
    sample: int | None = None,
) -> list[str]:
    """Import a network on top of what is stored; known stations and routes keep their ids.

    Two such loads at once would number new stations alike: the slower one is not
    published and raises ``Conflict``; run it again.
    """
    spark = feed.sparkSession
    stored = parts(spark, base)
    known = current(spark, base) if stored else None
    tables = import_network(feed, lines, zones, sample, known)
    return refresh(tables, base, stamp, based_on={n: stored.get(n, []) for n in KEYS})
