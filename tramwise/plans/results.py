"""Results of reports, kept for a while and for one state of the tables.

A report that many screens ask for is computed once, written, and read again until its
time is over or a load is published. What was written outlives the executors that made
it, unlike a persisted frame.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .refresh import current, published, remove
from .reports import REPORTS, to_records

#: fixed value: seconds that a result lives
LIFE = 300.0
_PLACE = "_place"


@dataclass(frozen=True)
class Kept:
    """A written result: the record it belongs to, and when it was made."""

    path: str
    columns: StructType
    record: int
    made: float


class Results:
    """Reports over the stored tables of ``base``, results kept under ``folder``.

    A result is told by the report, its parameters and the newest record of the
    tables: a new load is seen at once. It is computed again after ``life`` seconds.
    Replaced results are removed one life later, when their readers are done.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        folder: str | None = None,
        life: float = LIFE,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.spark, self.base, self.life, self.clock = spark, base, life, clock
        self.folder = folder or f"{base}/_results"
        self._kept: dict[tuple, Kept] = {}
        self._retired: list[tuple[float, str]] = []

    def get(self, name: str, **params) -> DataFrame:
        """The rows of a report, in its order."""
        key = (name, tuple(sorted((k, repr(v)) for k, v in params.items())))
        record, now = published(self.spark, self.base), self.clock()
        held = self._kept.get(key)
        if held is None or held.record != record or now - held.made >= self.life:
            if held is not None:
                self._retired.append((now, held.path))
            held = self._kept[key] = self._write(name, params, record, now)
        self._sweep(now)
        stored = self.spark.read.schema(held.columns).parquet(held.path)
        return stored.orderBy(_PLACE).drop(_PLACE)

    def records(self, name: str, limit: int | None = None, **params) -> list[dict]:
        """The rows of a report as dictionaries."""
        return to_records(self.get(name, **params), limit)

    def forget(self) -> None:
        """Remove every result that is kept."""
        self._retired += [(float("-inf"), held.path) for held in self._kept.values()]
        self._kept.clear()
        self._sweep(float("inf"))

    def _write(self, name: str, params: dict, record: int, now: float) -> Kept:
        frame = REPORTS[name](current(self.spark, self.base), **params)
        # Ids rise from partition to partition, so they keep the order of a sorted report.
        placed = frame.withColumn(_PLACE, F.monotonically_increasing_id())
        path = f"{self.folder}/{name}-{uuid4().hex}"
        placed.write.parquet(path)
        return Kept(path, placed.schema, record, now)

    def _sweep(self, now: float) -> None:
        over = [path for since, path in self._retired if now - since >= self.life]
        self._retired = [(s, p) for s, p in self._retired if now - s < self.life]
        for path in over:
            remove(self.spark, path)
