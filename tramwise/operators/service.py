"""Status, reliability and availability of the service."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import first_day, first_instant, sunday_based_weekday
from ..functions.labels import NORMAL_SERVICE, service_state
from ..functions.order import ordered
from ..functions.stats import count_rows, ratio, rounded, rounded_mean_if
from ..schema import SERVICE_STATES
from ..sources.tables import Tables
from .common import delay, route_identity

CHECK_COLUMNS = (
    "availability_id",
    "check_time",
    "is_operational",
    "delay_minutes",
    "reason",
)


def operational() -> Column:
    return F.col("is_operational")


def latest_checks(checks: DataFrame) -> DataFrame:
    """The newest check of every route; equal instants go by the higher id.

    An aggregate rather than a ranking: map tasks send on one row per route,
    and they sort by route only. A check without an instant counts as newest,
    as it does in falling order.
    """
    at = F.col("check_time")
    age = F.struct(at.isNull().alias("unknown"), at, F.col("availability_id"))
    kept = [c for c in (*CHECK_COLUMNS, "current_capacity") if c in checks.columns]
    newest = F.max_by(F.struct(*kept), age).alias("newest")
    return checks.groupBy("route_id").agg(newest).select("route_id", "newest.*")


def with_state(frame: DataFrame) -> DataFrame:
    state = service_state(F.col("reason"), operational(), delay())
    return frame.withColumn("status", state)


@ordered("route_name", "route_id")
def current_service_status(t: Tables) -> DataFrame:
    """Newest status of every route; a route without checks runs normally."""
    return (
        route_identity(t)
        .join(latest_checks(t.service_availability), "route_id", "left")
        .select(
            "route_id",
            "route_name",
            "transport_type",
            F.coalesce(operational(), F.lit(True)).alias("is_operational"),
            F.coalesce(delay(), F.lit(0)).alias("delay_minutes"),
            F.coalesce("reason", F.lit(NORMAL_SERVICE)).alias("reason"),
            "check_time",
        )
    )


@ordered("route_name", "route_id")
def service_status_categories(t: Tables) -> DataFrame:
    """Current status with its category in words."""
    return with_state(current_service_status(t, sort=False))


@ordered("status")
def status_summary(t: Tables) -> DataFrame:
    """Number of routes in each of the four categories, zeros included."""
    states = service_status_categories(t, sort=False)
    counts = states.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in SERVICE_STATES]
    )
    return counts.unpivot([], list(SERVICE_STATES), "status", "n")


@ordered("Route", "Type", "Status", "Delay (min)")
def status_board(t: Tables, states: Iterable[str] | None = None) -> DataFrame:
    """The display form of the current status, for the chosen categories."""
    rows = service_status_categories(t, sort=False)
    if states is not None:
        rows = rows.filter(F.col("status").isin(*states))
    return rows.select(
        F.col("route_name").alias("Route"),
        F.col("transport_type").alias("Type"),
        F.col("status").alias("Status"),
        F.coalesce(delay(), F.lit(0)).cast("int").alias("Delay (min)"),
        F.col("reason").alias("Reason"),
    )


@ordered("-reliability_percent", "route_name", "route_id")
def service_reliability(
    t: Tables, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Checks since ``days`` before ``as_of``, by outcome, per checked route.

    A failed check with a delay counts as delayed, one without as cancelled.
    """
    late = ~operational() & (delay() > 0)
    recent = t.service_availability.filter(
        F.col("check_time") >= first_instant(as_of, days)
    )
    counts = recent.groupBy("route_id").agg(
        count_rows().alias("total_checks"),
        F.count_if(operational()).alias("active_count"),
        F.count_if(late).alias("delayed_count"),
        F.count_if(~operational() & (delay() == 0)).alias("cancelled_count"),
        rounded_mean_if(late, delay()).alias("avg_delay_when_delayed"),
    )
    return route_identity(t).join(counts, "route_id").select(
        "route_id",
        "route_name",
        "transport_type",
        "total_checks",
        "active_count",
        "delayed_count",
        "cancelled_count",
        _percent(F.col("active_count"), F.col("total_checks")).alias(
            "reliability_percent"
        ),
        "avg_delay_when_delayed",
    )


def _percent(part: Column, whole: Column) -> Column:
    return rounded(ratio(part * 100, whole))


@ordered("reliability_percent", "route_name", "route_id")
def reliability_ranking(
    t: Tables, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """:func:`service_reliability` with the weakest routes first."""
    return service_reliability(t, days, as_of, sort=False)


@ordered("-check_date", "route_name", "route_id", "hour", "status", "delay_minutes")
def availability_summary(
    t: Tables, days: int = 90, as_of: datetime | None = None
) -> DataFrame:
    """Checks counted by day, hour, route, category, delay and reason.

    The day bound is put on ``check_time`` itself, so that the scan can use it.
    """
    midnight = first_day(as_of, days).cast("timestamp_ntz")
    recent = t.service_availability.filter(F.col("check_time") >= midnight)
    counts = (
        with_state(recent)
        .groupBy(
            F.to_date("check_time").alias("check_date"),
            F.hour("check_time").alias("hour"),
            "route_id",
            "status",
            "delay_minutes",
            "reason",
        )
        .agg(count_rows().alias("status_count"))
    )
    return counts.join(route_identity(t), "route_id").select(
        "check_date",
        sunday_based_weekday(F.col("check_date")).alias("day_of_week"),
        "hour",
        "route_id",
        "route_name",
        "transport_type",
        "status",
        "delay_minutes",
        "reason",
        "status_count",
    )
