"""From raw station feeds and stop lists to stations and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calendar import hour_of_minute, in_hours, weekday_name
from ..functions.labels import line_mode
from ..functions.stats import count_rows
from ..schema import DEFAULTS, IMPORT_PEAK_HOURS, LAYOUTS
from .common import top_per_group

# fixed values: names in the feed and ours, columns a feed must have
FEED_NAMES = {"gtfs_latitude": "stop_lat", "gtfs_longitude": "stop_lon"}
FEED_COLUMNS = ("stop_name", "borough", "stop_lat", "stop_lon", "ada")

# fixed value: fare of a new line
NEW_LINE_FARE = "2.75"


class MissingColumns(ValueError):
    """A feed lacks columns that the station table needs."""


def clean_feed(feed: DataFrame) -> DataFrame:
    """Rename the coordinates and keep the id and the needed columns."""
    feed = feed.withColumnsRenamed(FEED_NAMES)
    missing = [c for c in FEED_COLUMNS if c not in feed.columns]
    if missing:
        raise MissingColumns(", ".join(missing))
    ids = ["station_id"] if "station_id" in feed.columns else []
    return feed.select(*ids, *FEED_COLUMNS)


def dedup_by_key(frame: DataFrame, key: str, *first_by: str) -> DataFrame:
    """The first row of every key in a stated order.

    The order should tell the rows of a key apart, so that the kept row does
    not depend on how the input was split.
    """
    order = [F.col(c).asc_nulls_last() for c in first_by]
    return top_per_group(frame, [key], order, 1)


def distinct_stations(feed: DataFrame) -> DataFrame:
    """One cleaned row per station id; feeds repeat a station for each line."""
    return dedup_by_key(clean_feed(feed), "station_id", *FEED_COLUMNS)


def stratified_sample(
    stations: DataFrame,
    per_stratum: int,
    stratum: str = "borough",
    key: str = "station_id",
    seed: int = 42,
) -> DataFrame:
    """At most ``per_stratum`` seeded random rows of each known stratum.

    Rows are drawn by the hash of seed and key: the draw is the same for any
    split of the input, and each task keeps only a few rows of a stratum.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    drawn = stations.withColumn("_draw", draw)
    order = [F.col("_draw").asc(), F.col(key).asc()]
    known = drawn.filter(F.col(stratum).isNotNull())
    return top_per_group(known, [stratum], order, per_stratum).drop("_draw")


def lookup_zone(stations: DataFrame, zones: DataFrame) -> DataFrame:
    """Add the zone id of each station's borough; unknown boroughs give NULL."""
    # A name that was given twice stands for the zone that came last.
    ids = zones.groupBy(F.col("zone_name").alias("borough")).agg(
        F.max("zone_id").alias("zone_id")
    )
    return stations.join(ids, "borough", "left")


def surrogate_keys(
    frame: DataFrame, natural_key: str, name: str, digits: int = 3
) -> DataFrame:
    """Gapless ids 1..n, in the order of (hash bucket, natural key).

    A plain row number would sort everything in one task. Here the md5 prefix
    spreads the distinct keys evenly over 16^digits buckets; rows are numbered
    inside their bucket and lifted by the size of the buckets before it. Only
    that table of bucket sizes is kept in one place and broadcast: ``digits`` is
    at most 4, so it has 65,536 rows at most. The rows are needed twice; store a
    costly frame first.
    """
    if not 1 <= digits <= 4:
        raise ValueError("digits must be from 1 to 4")
    text = F.coalesce(F.col(natural_key).cast("string"), F.lit("")).cast("binary")
    keyed = frame.withColumn("_bucket", F.substring(F.md5(text), 1, digits))
    sizes = keyed.groupBy("_bucket").agg(count_rows().alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(natural_key))
    return (
        keyed.withColumn("_number", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_number"))
        .drop("_bucket", "_offset", "_number")
    )


def stable_keys(
    frame: DataFrame,
    natural_key: str,
    name: str,
    known: DataFrame | None = None,
    digits: int = 3,
) -> DataFrame:
    """(natural key, id) of the known keys and of those that ``frame`` brings.

    Known keys keep their id, also those that ``frame`` lacks: an id is never given
    twice. New keys take the ids after the largest, as :func:`surrogate_keys` numbers
    them, so that ids stay gapless. NULL keys get none.
    """
    keys = frame.select(natural_key).filter(F.col(natural_key).isNotNull()).distinct()
    if known is None:
        return surrogate_keys(keys, natural_key, name, digits).select(
            natural_key, F.col(name).cast("bigint").alias(name)
        )
    known = known.select(
        F.col(natural_key).cast(keys.schema[natural_key].dataType).alias(natural_key),
        F.col(name).cast("bigint").alias(name),
    )
    new = surrogate_keys(
        keys.join(known, natural_key, "left_anti"), natural_key, name, digits
    )
    largest = known.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
    new = new.select(natural_key, (F.col(name) + largest).cast("bigint").alias(name))
    return known.unionByName(new)


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Cast to the layout of a table; absent columns and NULLs take defaults."""
    defaults = DEFAULTS.get(table, {})
    fields = StructType.fromDDL(LAYOUTS[table]).fields

    def column(field) -> Column:
        given = F.col(field.name) if field.name in frame.columns else F.lit(None)
        value = given.cast(field.dataType)
        if field.name in defaults:
            default = F.lit(defaults[field.name]).cast(field.dataType)
            value = F.coalesce(value, default)
        return value.alias(field.name)

    return frame.select(*[column(f) for f in fields])


def feed_faults(feed: DataFrame) -> DataFrame:
    """The cleaned feed with ``fault``: why a row cannot be loaded, or NULL.

    A broken line of JSON has neither id nor name. A coordinate may be missing but
    must be a number if it is there; an empty text is not.
    """
    cleaned = clean_feed(feed)

    def bad_number(name: str) -> Column:
        return F.col(name).isNotNull() & F.col(name).try_cast("double").isNull()

    fault = (
        F.when(F.col("station_id").isNull(), "no station_id")
        .when(F.col("stop_name").isNull(), "no stop_name")
        .when(bad_number("stop_lat"), "bad stop_lat")
        .when(bad_number("stop_lon"), "bad stop_lon")
    )
    return cleaned.withColumn("fault", fault)


def sound_rows(feed: DataFrame) -> DataFrame:
    """Rows of a feed that can be loaded; the others are in :func:`feed_rejects`."""
    return feed_faults(feed).filter(F.col("fault").isNull()).drop("fault")


def feed_rejects(feed: DataFrame) -> DataFrame:
    """Rows of a feed that cannot be loaded, each with its fault."""
    return feed_faults(feed).filter(F.col("fault").isNotNull())


def station_keys(feed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(feed_id, station_id) of the stations known and of those in a raw feed."""
    ids = sound_rows(feed).select(F.col("station_id").alias("feed_id"))
    return stable_keys(ids, "feed_id", "station_id", known)


def import_stations(
    feed: DataFrame, zones: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Station rows from a raw feed: one per id, zoned, numbered and typed.

    Rows with a fault are left out. The accessibility mark of the feed (1 means
    step-free, missing or no number means not) sets both the elevator and the
    wheelchair flag. ``keys`` holds the numbers of all its stations, as
    :func:`station_keys` gives them; without it they are numbered afresh.
    """
    zoned = lookup_zone(distinct_stations(sound_rows(feed)), zones)
    zoned = zoned.withColumnRenamed("station_id", "feed_id")
    if keys is None:
        numbered = surrogate_keys(zoned, "feed_id", "station_id")
    else:
        numbered = zoned.join(keys, "feed_id")
    step_free = F.coalesce(F.col("ada").try_cast("int"), F.lit(0)) == 1
    return numbered.select(
        F.col("station_id").cast("int").alias("station_id"),
        F.col("stop_name").alias("station_name"),
        "zone_id",
        # The feed gives text; it is read as a double first, as the source does.
        F.col("stop_lat").cast("double").cast("decimal(10,6)").alias("latitude"),
        F.col("stop_lon").cast("double").cast("decimal(10,6)").alias("longitude"),
        step_free.alias("has_elevator"),
        step_free.alias("wheelchair_accessible"),
    )


def routes_from_stop_lists(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """Routes from the first to the last known station of each line.

    Lines with fewer than two known stops drop out. Capacity and length are
    taken over when the lines carry them.
    """
    # A name that was given twice stands for the station that came last.
    known = stations.groupBy(F.col("station_name").alias("stop")).agg(
        F.max("station_id").alias("station_id")
    )
    stops = lines.select("line_id", F.posexplode("stops").alias("position", "stop"))
    ends = (
        stops.join(known, "stop")
        .groupBy("line_id")
        .agg(
            F.min_by("station_id", "position").alias("start_station_id"),
            F.max_by("station_id", "position").alias("end_station_id"),
            count_rows().alias("n_stops"),
        )
        .filter(F.col("n_stops") >= 2)
    )
    given = [c for c in ("distance_km", "max_capacity") if c in lines.columns]
    return lines.join(ends, "line_id").select(
        "line_id",
        F.col("line").alias("route_name"),
        line_mode(F.col("line")).alias("transport_type"),
        "start_station_id",
        "end_station_id",
        *given,
        F.lit(NEW_LINE_FARE).cast("decimal(10,2)").alias("base_fare"),
        F.lit(True).alias("wheelchair_accessible"),
        F.lit(True).alias("active"),
    )


def schedule_rows(raw: DataFrame) -> DataFrame:
    """Timetable rows; days may be names or the digits 0 (Sunday) to 6."""
    named = raw.withColumn("day_of_week", weekday_name(F.col("day_of_week")))
    return conform(named, "schedules")


def log_rows(raw: DataFrame, hours: tuple[int, ...] = IMPORT_PEAK_HOURS) -> DataFrame:
    """Travel-time logs with the peak flag set from their hour."""
    flag = hour_of_minute(F.col("log_min")).isin(*hours)
    return conform(raw.withColumn("is_peak_hour", flag), "travel_time_logs")


def trip_rows(raw: DataFrame, hours: tuple[int, ...] = IMPORT_PEAK_HOURS) -> DataFrame:
    """Trips with their day and peak flag set from the tap-in."""
    flagged = raw.withColumns(
        {
            "trip_date": F.to_date("tap_in_time"),
            "is_peak_hour": in_hours(F.col("tap_in_time"), hours),
        }
    )
    return conform(flagged, "trips")
