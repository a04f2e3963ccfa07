"""Averages and percentages with exact, order-independent sums.

A sum of doubles depends on the order in which tasks finish. The inputs here
are integers and short decimals, so they are summed exactly and turned into a
double once, after the division. Results are rounded half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes(name: str) -> Column:
    """A DECIMAL(5,2) duration widened so that its sum has room.

    Sums of up to eight digits still run on plain longs inside the aggregate
    and hold 10^16 minutes instead of 10^13.
    """
    return F.col(name).cast("decimal(8,2)")


def ratio(total: Column, n: Column) -> Column:
    """``total / n`` as a double; NULL when ``n`` is zero."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def mean(value: Column) -> Column:
    return ratio(F.sum(value), F.count(value))


def rounded(value: Column, digits: int = 2) -> Column:
    """Half away from zero, on decimals, so that x.xx5 goes up."""
    exact = value.cast("decimal(38,10)")
    return F.round(exact, digits).cast(f"decimal(18,{digits})")


def rounded_mean(value: Column) -> Column:
    return rounded(mean(value))


def rounded_mean_if(condition: Column, value: Column) -> Column:
    return rounded_mean(F.when(condition, value))


def rounded_deviation(value: Column) -> Column:
    """Sample standard deviation of integers; NULL for a single row.

    From exact sums of values and squares, so that the order of the rows and of
    the tasks cannot move it over a rounding edge.
    """
    return deviation(F.count(value), F.sum(value), sum_of_squares(value))


def sum_of_squares(value: Column) -> Column:
    """Exact, for 32-bit integers."""
    exact = value.cast("decimal(10,0)")
    return F.sum((exact * exact).cast("decimal(20,0)"))


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from a count and exact sums; NULL below two rows."""
    total = total.cast("decimal(18,0)")
    spread = n.cast("decimal(14,0)") * squares.cast("decimal(24,0)") - total * total
    return rounded(F.sqrt(ratio(spread, n * (n - 1))))


def share_of_capacity(load: Column, capacity: Column) -> Column:
    """Load as a percentage of capacity; NULL for a capacity of zero."""
    return rounded(ratio(load, capacity) * 100)


def count_rows() -> Column:
    return F.count(F.lit(1))


def at_least_one(n: Column) -> Column:
    """Row multiplier that an outer join gives its other side."""
    return F.greatest(n, F.lit(1))


def or_zero(n: Column) -> Column:
    return F.coalesce(n, F.lit(0))
