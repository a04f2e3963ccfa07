"""Landed raw files: station feeds and lists of stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STATION_FEED, STOP_LISTS


def read_feed(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """A station feed landed as JSON.

    One object per line is the form that large feeds should have: such files
    can be split. ``array=True`` reads the form a REST answer comes in, one
    array per file, which a single task has to parse.
    """
    return spark.read.schema(STATION_FEED).option("multiLine", array).json(path)


def parse_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column, one JSON object per row."""
    parsed = F.from_json(F.col(column), STATION_FEED)
    return lines.select(parsed.alias("row")).select("row.*")


def read_stop_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOP_LISTS).json(path)
