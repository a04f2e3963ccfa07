"""Loads into the stored tables.

Every load writes its rows as a snapshot next to the older ones and then records in one
small file which snapshots each table consists of: its own alone, or those before and
its own if it appends. Tables that a load does not bring stay as they are. Readers follow
the newest record, by its number, so they see either the old tables or all the new ones,
and a load that dies half-way leaves no trace but unused files. A stamp names the folder
of a snapshot and can be published once; what an unpublished one left behind is
overwritten.

A record is created only if none of its number is there. A load that finds its number
taken looks at that record and builds on it, so of two loads at once none is lost.

Tables derived from a fact (partial sums, rider sets, card counts; see
``operators.rollup``) are kept snapshot by snapshot of the fact. ``maintain`` stores those
of the snapshots that lack them; whatever is not stored yet is computed when it is read,
so a derived table never lags behind.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Mapping
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from ..schema import (
    DERIVED_LAYOUTS,
    LAYOUTS,
    LOAD_ORDER,
    PARTITION_COLUMNS,
    TIME_COLUMNS,
)
from ..sources.tables import Tables

RECORD = "number BIGINT, stamp STRING, tables MAP<STRING, ARRAY<STRING>>"
#: Seconds that a load waits for a record under way before it holds it for dead.
PATIENCE = 10.0

#: Derived tables: the fact of each, and how they follow from its rows.
DERIVED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "log_rollup": ("travel_time_logs", rollup.log_rollup),
    "load_counts": ("travel_time_logs", rollup.load_counts),
    "trip_rollup": ("trips", rollup.trip_rollup),
    "rider_sets": ("trips", rollup.rider_sets),
    "card_counts": ("trips", rollup.card_counts),
}


class Conflict(RuntimeError):
    """Another load changed a table that this one had built on."""


def laid_out(frame: DataFrame, name: str) -> DataFrame:
    """Rows gathered by the stored date and ordered by route inside the files.

    Rebalancing lets adaptive execution split a date that is far larger than
    the others over several tasks, and merge the small ones.
    """
    if name in TIME_COLUMNS:
        # Files of disjoint spans of time: readers skip those outside their bounds.
        return frame.repartitionByRange(TIME_COLUMNS[name], "route_id").sortWithinPartitions(
            TIME_COLUMNS[name], "route_id"
        )
    column = PARTITION_COLUMNS.get(name)
    if column is None:
        return frame
    return frame.hint("rebalance", F.col(column)).sortWithinPartitions(
        column, "route_id"
    )


def refresh(
    t: Tables,
    base: str,
    stamp: str,
    append: Iterable[str] = (),
    based_on: Mapping[str, list[str]] | None = None,
) -> list[str]:
    """Write a snapshot of all given tables, parents first, and publish it.

    Tables named in ``append`` keep their earlier snapshots. ``based_on`` gives the
    snapshots (see :func:`parts`) of tables whose rows went into the new ones; if
    another load changed them since, nothing is published and ``Conflict`` is raised.
    """
    frames = t.present() | t.derived()
    names = [n for n in LOAD_ORDER if n in frames]
    names += [n for n in frames if n not in names]
    spark = next(iter(frames.values())).sparkSession
    if _stamped(spark, base, stamp):
        raise ValueError(f"{stamp} is published; its files may be in use")
    for name in names:
        writer = laid_out(frames[name], name).write.mode("overwrite")
        if name in PARTITION_COLUMNS:
            writer = writer.partitionBy(PARTITION_COLUMNS[name])
        writer.parquet(_snapshot(base, stamp, name))

    def built_on(tables: dict[str, list[str]]) -> dict[str, list[str]]:
        for name, held in (based_on or {}).items():
            if tables.get(name, []) != held:
                raise Conflict(f"another load changed {name}")
        kept = {n: tables.get(n, []) if n in append else [] for n in names}
        return tables | {n: [*kept[n], stamp] for n in names}

    _publish(spark, base, stamp, built_on)
    return names


def maintain(spark: SparkSession, base: str, names: Iterable[str] = tuple(DERIVED)) -> list[str]:
    """Store the derived tables of every snapshot that lacks them; list what was read.

    Only those snapshots are read: the record itself is the mark up to which a derived
    table counts its fact.
    """
    stored = parts(spark, base)
    done = []
    for name in names:
        fact, derive = DERIVED[name]
        for stamp in stored.get(fact, []):
            if stamp not in stored.get(name, []):
                rows = derive(_read(spark, base, stamp, fact))
                rows.write.mode("overwrite").parquet(_snapshot(base, stamp, name))
                done.append(f"{name}/{stamp}")
    if done:
        written: dict[str, list[str]] = {}
        for entry in done:
            name, stamp = entry.split("/", 1)
            written.setdefault(name, []).append(stamp)

        def built_on(tables: dict[str, list[str]]) -> dict[str, list[str]]:
            held = dict(tables)
            for name, stamps in written.items():
                known = [*tables.get(name, []), *stamps]
                # Snapshots that a load replaced meanwhile are none any more.
                held[name] = [s for s in tables.get(DERIVED[name][0], []) if s in known]
            return held

        _publish(spark, base, f"derived of {max(s for v in written.values() for s in v)}", built_on)
    return done


def current(spark: SparkSession, base: str) -> Tables:
    """The tables as last published, and those derived from them."""
    newest = _newest(spark, base)
    if newest is None:
        raise FileNotFoundError(f"nothing was published under {base}")
    stored = newest["tables"]

    def whole(name: str) -> DataFrame:
        return _union([_read(spark, base, stamp, name) for stamp in stored[name]])

    def derived(name: str) -> DataFrame:
        fact, derive = DERIVED[name]
        held = stored.get(name, [])
        pieces = [s for s in stored[fact] if s in held]
        missing = [s for s in stored[fact] if s not in held]
        frames = [_read(spark, base, s, name) for s in pieces]
        if missing:
            frames.append(derive(_union([_read(spark, base, s, fact) for s in missing])))
        return _union(frames)

    frames: dict[str, Callable[[], DataFrame]] = {
        n: partial(whole, n)
        for n, held in stored.items()
        # Older records may name derived tables that are kept in another form now.
        if held and n not in DERIVED and (n in LAYOUTS or n in DERIVED_LAYOUTS)
    }
    frames |= {n: partial(derived, n) for n, (fact, _) in DERIVED.items() if stored.get(fact)}
    return Tables(**frames)


def parts(spark: SparkSession, base: str) -> dict[str, list[str]]:
    """The snapshots that each table consists of; nothing if none was published."""
    newest = _newest(spark, base)
    return newest["tables"] if newest else {}


def published(spark: SparkSession, base: str) -> int:
    """The number of the newest record; -1 if nothing was published."""
    newest = _newest(spark, base)
    return newest["number"] if newest else -1


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _read(spark: SparkSession, base: str, stamp: str, name: str) -> DataFrame:
    layout = LAYOUTS.get(name) or DERIVED_LAYOUTS[name]
    return spark.read.schema(layout).parquet(_snapshot(base, stamp, name))


def _publish(spark: SparkSession, base: str, stamp: str, built_on: Callable) -> None:
    """Create the next record; where another load was faster, on top of that load's."""
    number, waited = -1, 0.0
    while True:
        last = _newest(spark, base)
        free = last["number"] + 1 if last else 0
        if free <= number and waited < PATIENCE:  # its record is still being written
            time.sleep(0.5)
            waited += 0.5
            continue
        number, waited = max(free, number + 1), 0.0
        tables = built_on(dict(last["tables"]) if last else {})
        record = json.dumps({"number": number, "stamp": stamp, "tables": tables})
        if create_only(spark, f"{base}/_commits/{number:012d}.json", record):
            return


def create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of that name already.

    File systems do this in one step, which no reader or writer of Spark offers.
    """
    gateway = spark.sparkContext._jvm
    place = gateway.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; it may be gone already."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _records(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        records = spark.read.schema(RECORD).json(f"{base}/_commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return records.filter(F.col("number").isNotNull() & F.col("tables").isNotNull())


def _newest(spark: SparkSession, base: str) -> dict | None:
    """The whole record of the highest number."""
    records = _records(spark, base)
    row = records.orderBy(F.col("number").desc()).first() if records is not None else None
    return row.asDict() if row is not None else None


def _stamped(spark: SparkSession, base: str, stamp: str) -> bool:
    records = _records(spark, base)
    return records is not None and not records.filter(F.col("stamp") == stamp).isEmpty()


def _snapshot(base: str, stamp: str, name: str) -> str:
    return f"{base}/{stamp}/{name}"
