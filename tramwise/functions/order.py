"""Row order at the edge of a report.

Nulls come last in rising and first in falling order. Every order ends in
enough columns to spread ties, so that a range shuffle never has to put one
repeated sort value into a single task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rising(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def falling(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def sort_columns(keys: tuple[str, ...]) -> list[Column]:
    """``"name"`` sorts up, ``"-name"`` down."""
    return [falling(k[1:]) if k.startswith("-") else rising(k) for k in keys]


def ordered(*keys: str) -> Callable:
    """Give an operator its reading order; ``sort=False`` leaves the sort out.

    A sort costs a range shuffle of the whole result, so writers and callers
    that go on working with the frame turn it off.
    """

    def decorate(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(build)
        def run(*args, sort: bool = True, **params) -> DataFrame:
            frame = build(*args, **params)
            return frame.orderBy(*sort_columns(keys)) if sort else frame

        run.sort_keys = keys
        return run

    return decorate
