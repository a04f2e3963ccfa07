"""Row-by-row comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(
            f"create view {path.stem} as select * from read_parquet('{path}')"
        )
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


# What the driver may call a DuckDB type and Spark's name for the same.
TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    described = connection.execute(f"describe {sql}").fetchall()
    expected_types = {name: TYPES.get(kind, kind) for name, kind, *_ in described}
    found = []
    if dict(frame.dtypes) != expected_types:
        pairs = set(frame.dtypes) ^ set(expected_types.items())
        found.append(f"types differ: {sorted(pairs)}")
    names = [name for name, *_ in described]
    if sorted(names) != sorted(frame.columns):
        return [*found, "columns differ"]
    expected = _rows(names, connection.execute(sql).fetchall())
    actual = _rows(frame.columns, frame.collect())
    if actual != expected:
        missing, surplus = expected - actual, actual - expected
        found.append(
            f"{sum(missing.values())} rows missing, {sum(surplus.values())} surplus; "
            f"e.g. {next(iter(missing), None)} / {next(iter(surplus), None)}"
        )
    return found
