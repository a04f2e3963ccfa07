"""A third of the rows on one key: same results, work still spread."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows

from tramwise.operators import capacity, performance, ridership, service
from tramwise.sources import star

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowded(spark):
    return crowded_tables(spark, SF_DIR)


def crowded_tables(spark, sf_dir):
    """Every third log, check, trip and booking belongs to route 1 (or card 1)."""
    t = star.tables(spark, sf_dir, shift_checks=True)

    def crowd(frame, column, by):
        hot = F.pmod(F.xxhash64(*by), F.lit(3)) == 0
        kind = frame.schema[column].dataType
        value = F.when(hot, F.lit(1).cast(kind)).otherwise(F.col(column))
        return frame.withColumn(column, value)

    return t.with_(
        travel_time_logs=crowd(t.travel_time_logs, "route_id", ["log_id", "log_min"]),
        service_availability=crowd(
            t.service_availability, "route_id", ["availability_id"]
        ),
        trips=crowd(
            crowd(t.trips, "route_id", ["trip_id"]), "card_id", ["trip_id"]
        ),
        bookings=crowd(t.bookings, "route_id", ["booking_id"]),
        passenger_logs=crowd(
            t.passenger_logs, "route_id", ["ts", "passenger_count"]
        ),
    )


def test_summary_by_brute_force(crowded):
    logs = defaultdict(list)
    for r in rows(crowded.travel_time_logs):
        logs[r["route_id"]].append(r)
    capacity_of = {r["route_id"]: r["max_capacity"] for r in rows(crowded.routes)}
    biggest = max(len(group) for group in logs.values())
    assert biggest > sum(len(group) for group in logs.values()) / 4
    found = {r["route_id"]: r for r in rows(performance.route_summary(crowded))}
    assert set(found) == set(capacity_of)
    for route, group in logs.items():
        row = found[route]
        assert row["days_with_data"] == len({r["log_date"] for r in group})
        assert row["near_capacity_trips"] == sum(
            r["passenger_count"] * 10 >= capacity_of[route] * 9 for r in group
        )
        mean = sum(r["delay_minutes"] for r in group) / len(group)
        assert abs(float(row["avg_delay_min"]) - mean) <= 0.005 + 1e-9


def test_latest_status_by_brute_force(crowded):
    newest = {}
    for r in rows(crowded.service_availability):
        age = (r["check_time"], r["availability_id"])
        if r["route_id"] not in newest or age > newest[r["route_id"]][0]:
            newest[r["route_id"]] = (age, r)
    for r in rows(service.current_service_status(crowded)):
        if r["route_id"] in newest:
            assert r["check_time"] == newest[r["route_id"]][1]["check_time"]


FORCED_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def joined_export(t):
    return performance.route_performance_export(t, sort=False)


def joined_bookings(t):
    return capacity.booking_list(t, sort=False)


@pytest.mark.parametrize("report", [joined_export, joined_bookings])
def test_row_level_joins_under_forced_skew(report, spark):
    """Shuffle joins only, and skew splitting forced."""
    # Several map tasks, as a large table has: a partition is split between them.
    crowded = crowded_tables(spark, "/root/testdata/sf0.01")
    t = crowded.with_(
        travel_time_logs=crowded.travel_time_logs.repartition(8),
        service_availability=crowded.service_availability.repartition(8),
        bookings=crowded.bookings.repartition(8),
    )
    usual = sorted(map(str, rows(report(t))))
    old = {k: spark.conf.get(k, None) for k in FORCED_SKEW}
    for key, value in FORCED_SKEW.items():
        spark.conf.set(key, value)
    try:
        frame = report(t)
        split = sorted(map(str, rows(frame)))
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert split == usual
    assert "skew=true" in plan and "BroadcastHashJoin" not in plan


def test_riders_and_overload_by_brute_force(crowded):
    riders = defaultdict(set)
    for r in rows(crowded.trips):
        riders[r["route_id"]].add(r["card_id"])
    for r in rows(ridership.route_performance(crowded)):
        assert r["unique_riders"] == len(riders[r["route_id"]])

    names = {r["route_id"]: r for r in rows(crowded.transport_routes)}
    logs, booked = defaultdict(list), defaultdict(int)
    for r in rows(crowded.passenger_logs):
        logs[r["route_id"], r["ts"]].append(r["passenger_count"])
    for r in rows(crowded.bookings):
        booked[r["route_id"], r["ts"]] += 1
    expected = {}
    for (route, ts), loads in logs.items():
        n = booked[route, ts]
        total = sum(loads) * max(n, 1) + len(loads) * n
        if route in names and total > names[route]["max_capacity"]:
            expected[names[route]["route_name"], ts] = total
    found = {
        (r["route_name"], r["timestamp"]): r["total_passengers"]
        for r in rows(capacity.overloaded_services(crowded))
    }
    assert found == expected
