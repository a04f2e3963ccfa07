"""Stations from a stream of feed files.

The first row of each station, in the order that the batch import states, is kept in the
state of the query and grows smaller at most, so files may arrive in any order and split.
Each batch writes the stations whose row changed, with numbers for those never seen, into
a folder of its own; a batch that is run again replaces it. Faulty rows go to an output
of their own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import (
    FEED_COLUMNS,
    feed_rejects,
    import_stations,
    sound_rows,
    stable_keys,
)
from ..schema import STATION_FEED, STATION_KEYS
from ..session import checkpoint_root

CHANGES = "station_id STRING, " + ", ".join(f"{c} STRING" for c in FEED_COLUMNS)


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Feed files that land as JSON lines."""
    return (
        spark.readStream.schema(STATION_FEED)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def first_rows(feed: DataFrame) -> DataFrame:
    """The first sound row of every station, by all columns, NULLs last."""
    order = [part for c in FEED_COLUMNS for part in (F.col(c).isNull(), F.col(c))]
    return (
        sound_rows(feed)
        .groupBy("station_id")
        .agg(F.min(F.struct(*[p.alias(f"_{i}") for i, p in enumerate(order)])).alias("first"))
        .select(
            "station_id",
            *[F.col(f"first._{2 * i + 1}").alias(c) for i, c in enumerate(FEED_COLUMNS)],
        )
    )


def start_stations(
    feed: DataFrame, out: str, checkpoint: str | None = None, **trigger
) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries: stations to ``out``, rows that cannot be loaded to ``out/rejects``.

    Each sees every file once, also over restarts with the same checkpoint.
    """
    spark = feed.sparkSession
    location = checkpoint or f"{checkpoint_root(spark)}/stations"
    when = trigger or {"availableNow": True}

    def write(batch: DataFrame, number: int) -> None:
        known = _before(spark, f"{out}/keys", STATION_KEYS, number)
        ids = batch.select(F.col("station_id").alias("feed_id"))
        new = stable_keys(ids, "feed_id", "station_id", known)
        new = new.join(known.select("feed_id"), "feed_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    stations = (
        first_rows(feed)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{location}/stations")
        .trigger(**when)
        .foreachBatch(write)
        .start()
    )
    rejects = (
        feed_rejects(feed)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/rejects")
        .option("checkpointLocation", f"{location}/rejects")
        .trigger(**when)
        .start()
    )
    return stations, rejects


def current_stations(spark: SparkSession, out: str, zones: DataFrame) -> DataFrame:
    """Station rows as the batch import gives them; numbers never change."""
    changes = _before(spark, f"{out}/changes", CHANGES)
    cells = F.struct(*FEED_COLUMNS)
    newest = (
        changes.groupBy("station_id")
        .agg(F.max_by(cells, "batch").alias("row"))
        .select("station_id", "row.*")
    )
    keys = _before(spark, f"{out}/keys", STATION_KEYS).drop("batch")
    return import_stations(newest, zones, keys)


def _before(spark: SparkSession, path: str, layout: str, number: int | None = None) -> DataFrame:
    """What the batches before ``number`` wrote, or all of them."""
    schema = f"{layout}, batch BIGINT"
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found if number is None else found.filter(F.col("batch") < number)
