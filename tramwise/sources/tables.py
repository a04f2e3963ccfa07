"""The record of transit tables that every operator takes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..schema import DERIVED_LAYOUTS, LAYOUTS


class Tables:
    """The transit tables as lazy frames; leave out what a query does not read.

    A table may be given as a function, which is called when the table is first
    read: sources can offer all tables without building each one's plan.
    """

    def __init__(self, **frames: DataFrame | Callable[[], DataFrame]):
        unknown = set(frames) - set(LAYOUTS) - set(DERIVED_LAYOUTS)
        if unknown:
            raise TypeError(f"no such tables: {sorted(unknown)}")
        self._frames = frames

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            raise AttributeError(f"no table {name!r} was given")
        if not isinstance(frames[name], DataFrame):
            frames[name] = frames[name]()
        return frames[name]

    def with_(self, **frames: DataFrame | Callable[[], DataFrame]) -> Tables:
        """A copy with some tables replaced or added."""
        return Tables(**{**self._frames, **frames})

    def names(self) -> list[str]:
        """The given tables; those derived from them are not among them."""
        return [name for name in LAYOUTS if name in self._frames]

    def derived(self) -> dict[str, DataFrame]:
        """The derived tables that are there."""
        return {n: getattr(self, n) for n in DERIVED_LAYOUTS if n in self._frames}

    def present(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}

    def register_views(self, aliases: Mapping[str, str] | None = None) -> None:
        """Temp views under the table names, for SQL users.

        ``zones`` is also known as ``zone_metadata``.
        """
        names = {"zone_metadata": "zones", **(aliases or {})}
        frames = self.present()
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        for alias, name in names.items():
            if name in frames:
                frames[name].createOrReplaceTempView(alias)


def from_parquet(spark: SparkSession, base: str, names=tuple(LAYOUTS)) -> Tables:
    """Tables stored as ``base/<name>`` in the canonical layout.

    The declared schema saves the inference job and keeps missing optional
    columns as NULL.
    """

    def scan(name: str) -> DataFrame:
        return spark.read.schema(LAYOUTS[name]).parquet(f"{base}/{name}")

    return Tables(**{n: partial(scan, n) for n in names})


def from_catalog(spark: SparkSession, database: str, names=tuple(LAYOUTS)) -> Tables:
    return Tables(**{n: partial(spark.table, f"{database}.{n}") for n in names})


def from_jdbc(
    spark: SparkSession,
    url: str,
    names=tuple(LAYOUTS),
    split: Mapping[str, tuple[str, int, int, int]] | None = None,
    **options: str,
) -> Tables:
    """Tables of an external database.

    ``split`` gives ``(column, lower, upper, parts)`` for tables that should be
    read by several tasks; credentials belong in ``options``.
    """
    split = split or {}

    def scan(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if name in split:
            column, lower, upper, parts = split[name]
            reader = reader.options(
                partitionColumn=column,
                lowerBound=lower,
                upperBound=upper,
                numPartitions=parts,
            )
        return reader.load()

    return Tables(**{n: partial(scan, n) for n in names})
