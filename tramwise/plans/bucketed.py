"""Logs and checks stored side by side for the wide export.

Both facts are stored as tables in buckets of (route, date, hour) and sorted within
them, so that the one join of two facts reads them bucket by bucket: no row of either is
shuffled. The key spreads a crowded route over its hours. Dimensions are small and joined
as ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import performance
from ..sources.tables import Tables

KEYS = performance.IN_HOUR


def store_bucketed(t: Tables, database: str, buckets: int = 256) -> None:
    """Write both facts into ``database``; ``buckets`` of about 1 GB each are a good number."""
    for name, frame in _facts(t).items():
        dealt = frame.repartition(buckets, *KEYS)
        writer = dealt.write.format("parquet").mode("overwrite")
        writer.bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(f"{database}.{name}")


def bucketed_export(spark: SparkSession, t: Tables, database: str, sort: bool = False) -> DataFrame:
    """The wide export from the bucketed facts and the dimensions of ``t``."""
    logs, checks = (spark.table(f"{database}.{name}") for name in _NAMES)
    return performance.wide_rows(t, logs, checks, sort)


_NAMES = ("hourly_logs", "hourly_checks")


def _facts(t: Tables) -> dict[str, DataFrame]:
    return dict(zip(_NAMES, (performance.hourly_logs(t), performance.hourly_checks(t))))
