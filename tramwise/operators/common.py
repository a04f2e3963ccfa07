"""Building blocks shared by the operator modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import minutes, rounded_mean
from ..sources.tables import Tables

#: Rows of a part that one task groups, about.
PART_ROWS = 1 << 20


def ride_minutes() -> Column:
    return minutes("avg_travel_time")


def delay() -> Column:
    return F.col("delay_minutes")


def passengers() -> Column:
    return F.col("passenger_count")


def in_peak() -> Column:
    return F.col("is_peak_hour")


def with_station_names(t: Tables, routes: DataFrame, zones: bool = False) -> DataFrame:
    """Add the names of both ends, and of their zones when asked.

    Routes without a known station (or zone) drop out. The dimensions are joined
    one after the other, each with its own size to judge by: Spark overrates the
    size of a join of two of them.
    """
    for end in ("start", "end"):
        stop = t.stations.select(
            F.col("station_id").alias(f"{end}_station_id"),
            F.col("station_name").alias(f"{end}_station"),
            F.col("zone_id").alias(f"{end}_zone_id"),
        )
        routes = routes.join(stop, f"{end}_station_id")
        if zones:
            names = t.zones.select(
                F.col("zone_id").alias(f"{end}_zone_id"),
                F.col("zone_name").alias(f"{end}_zone"),
            )
            routes = routes.join(names, f"{end}_zone_id")
    return routes


def route_identity(t: Tables, *more: str) -> DataFrame:
    return t.routes.select("route_id", "route_name", "transport_type", *more)


def route_means(logs: DataFrame) -> DataFrame:
    """Mean ride time and delay of every route that has logs."""
    return logs.groupBy("route_id").agg(
        rounded_mean(ride_minutes()).alias("avg_travel_time_min"),
        rounded_mean(delay()).alias("avg_delay_min"),
    )


def only(frame: DataFrame, *conditions: Column | None) -> DataFrame:
    """Apply the conditions that were asked for."""
    for condition in conditions:
        if condition is not None:
            frame = frame.filter(condition)
    return frame


def equals(name: str, value) -> Column | None:
    """``name = value``, or no condition for ``None``."""
    return None if value is None else F.col(name) == value


def accessible_only(wanted: bool, name: str = "wheelchair_accessible") -> Column | None:
    return F.col(name) if wanted else None


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``frame``, of about ``rows`` rows, shuffled by ``keys`` into parts of bounded size.

    For groups that are nearly as many as the rows. Adding them up before the shuffle would
    hold all groups of a file split in memory and save nothing, and after it all those of a
    partition, whose number does not follow the table. What groups or joins by ``keys``
    next needs no other shuffle.
    """
    parts = max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return frame.repartition(parts, *keys)


def top_per_group(
    frame: DataFrame, group: list[str], order: list[Column], n: int
) -> DataFrame:
    """First ``n`` rows of every group.

    The filter sits right on the window, so Spark cuts each group down inside
    the map tasks (window group limit) before anything is shuffled.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return frame.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
