"""The export pack: seven data sets under one time stamp."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import ExitStack
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import performance, rollup, service, stations
from ..sources.tables import Tables
from .reports import kept

MANIFEST = "dataset STRING, path STRING, rows BIGINT"

# fixed values: names of the data sets, in order of writing
DATASETS = {
    "route_performance": performance.route_performance_export,
    "route_summary": rollup.route_summary,
    "daily_metrics": rollup.daily_metrics,
    "hourly_patterns": rollup.hourly_patterns,
    "weather_impact": rollup.weather_by_route,
    "service_availability": service.availability_summary,
    "stations": stations.station_connectivity,
}
#: Sets that are added up from partial sums of the logs.
ROLLED = {"route_summary", "daily_metrics", "hourly_patterns", "weather_impact"}


def write_csv(frame: DataFrame, path: str) -> int:
    """Write with a header and return the number of rows written.

    The rows are counted on their way to the files, not in a second run.
    """
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def export_pack(
    t: Tables,
    out: str,
    as_of: datetime | None = None,
    only: Iterable[str] = tuple(DATASETS),
    sort: bool = False,
) -> DataFrame:
    """Write the data sets to ``out/<stamp>/<data set>`` and list them.

    ``as_of`` names the stamp and bounds the look-back window; writing the same
    stamp again replaces its files. ``sort=True`` orders the rows of every set, at
    the price of a range shuffle of the wide row-level one.

    The logs are read once for the wide set. The sets added up from them come from
    the stored partial sums; where the tables have none, the sums are made here, with
    two more scans of the logs, and held while the sets are written.
    """
    only = tuple(only)
    stamp = (as_of or datetime.now()).strftime("%Y%m%d_%H%M%S")
    written = []
    with ExitStack() as held:
        if ROLLED & set(only) and "log_rollup" not in t.derived():
            sums = rollup.log_rollup(t.travel_time_logs)
            t = t.with_(
                log_rollup=held.enter_context(kept(sums)),
                load_counts=rollup.load_counts(t.travel_time_logs),
            )
        for name in only:
            bounds = {"as_of": as_of} if name == "service_availability" else {}
            path = f"{out}/{stamp}/{name}"
            rows = write_csv(DATASETS[name](t, sort=sort, **bounds), path)
            written.append((name, path, rows))
    return t.routes.sparkSession.createDataFrame(written, MANIFEST)
