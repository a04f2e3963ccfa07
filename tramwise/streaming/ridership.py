"""Daily ridership over a stream of taps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.stats import count_rows, ratio
from ..operators.ridership import fare
from ..schema import TRIPS
from ..session import checkpoint_root

LATENESS = "1 day"


def read_taps(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Trips that land as parquet files."""
    return (
        spark.readStream.schema(TRIPS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def daily_ridership(taps: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Trips, distinct riders and revenue of every closed day.

    A day closes once a tap later than its end plus ``lateness`` was seen.
    Streams cannot count distinct values, so each day is first grouped by card:
    the second step then counts every rider once, exactly. It also spreads a
    busy day over all tasks, and the state holds the cards of open days only.
    """
    zone = taps.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC"):
        raise ValueError(f"days are cut in UTC, but the session zone is {zone}")
    per_card = (
        taps.select(
            F.col("tap_in_time").cast("timestamp_ltz").alias("at"),
            "card_id",
            "fare_paid",
        )
        .withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day"), "card_id")
        .agg(
            count_rows().alias("trips"),
            F.sum("fare_paid").alias("revenue"),
            F.count("fare_paid").alias("fares"),
        )
    )
    revenue = F.sum("revenue")
    return (
        per_card.groupBy(F.window(F.window_time("window"), "1 day").alias("day"))
        .agg(
            F.sum("trips").alias("total_trips"),
            F.count("card_id").alias("unique_riders"),
            revenue.alias("total_revenue"),
            ratio(revenue, F.sum("fares")).alias("avg_fare"),
        )
        .select(
            F.to_date("day.start").alias("trip_date"),
            "total_trips",
            "unique_riders",
            "total_revenue",
            "avg_fare",
        )
    )


def start_daily_ridership(
    taps: DataFrame, out: str, checkpoint: str | None = None, **trigger
) -> StreamingQuery:
    """Append every closed day to a parquet folder."""
    location = checkpoint or f"{checkpoint_root(taps.sparkSession)}/daily_ridership"
    return (
        daily_ridership(taps)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", location)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# -- Taps behind the watermark ------------------------------------------------

DAYS = (
    "trip_date DATE, total_trips BIGINT, unique_riders BIGINT, "
    "total_revenue DECIMAL(38,2), avg_fare DOUBLE"
)


class LateTaps(StreamingQueryListener):
    """Counts what a stream dropped because its day was closed, by query.

    Register with ``spark.streams.addListener``; where ``dropped`` is not zero,
    :func:`reconcile` brings the days in order. Rows are counted after taps of one
    card and day that arrived together were added up, so the number of taps is at
    least this.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        behind = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[key] = self.dropped.get(key, 0) + behind

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_days(landed: DataFrame, out: str) -> DataFrame:
    """Closed days whose landed taps exceed those counted: (trip_date, late_trips)."""
    closed = landed.sparkSession.read.schema(DAYS).parquet(out)
    taps = landed.groupBy(F.to_date("tap_in_time").alias("trip_date")).agg(
        count_rows().alias("landed")
    )
    late = F.col("landed") - F.col("total_trips")
    return (
        closed.select("trip_date", "total_trips")
        .join(taps, "trip_date")
        .select("trip_date", late.alias("late_trips"))
        .filter(F.col("late_trips") > 0)
    )


def reconcile(landed: DataFrame, out: str, run: int) -> None:
    """Count the closed days that late taps belong to again, from all landed taps.

    ``landed`` is the batch frame of the stream's source. Corrections of ``run`` lie
    next to ``out`` and replace what a run of that number left; the rows of the stream
    stay as they are. Only the days found late are counted again.
    """
    late = late_days(landed, out)
    day = F.to_date("tap_in_time").alias("trip_date")
    again = (
        landed.withColumn("trip_date", day)
        .join(late, "trip_date")
        .groupBy("trip_date", "card_id")
        .agg(
            count_rows().alias("n"),
            F.sum(fare()).alias("revenue"),
            F.count(fare()).alias("fares"),
            F.max("late_trips").alias("late_trips"),
        )
        .groupBy("trip_date")
        .agg(
            F.sum("n").alias("total_trips"),
            F.count("card_id").alias("unique_riders"),
            F.sum("revenue").cast("decimal(38,2)").alias("total_revenue"),
            ratio(F.sum("revenue"), F.sum("fares")).alias("avg_fare"),
            F.max("late_trips").alias("late_trips"),
        )
    )
    again.write.mode("overwrite").parquet(f"{corrections(out)}/run={run}")


def corrections(out: str) -> str:
    return f"{out.rstrip('/')}_corrections"


def closed_days(spark: SparkSession, out: str) -> DataFrame:
    """The days of the stream as last reconciled, with the trips that came late."""
    days = spark.read.schema(DAYS).parquet(out).withColumns(
        {"late_trips": F.lit(0).cast("bigint"), "run": F.lit(-1).cast("bigint")}
    )
    try:
        schema = f"{DAYS}, late_trips BIGINT, run BIGINT"
        days = days.unionByName(spark.read.schema(schema).parquet(corrections(out)))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    cells = F.struct(*[c for c in days.columns if c not in ("trip_date", "run")])
    return days.groupBy("trip_date").agg(F.max_by(cells, "run").alias("row")).select(
        "trip_date", "row.*"
    )
