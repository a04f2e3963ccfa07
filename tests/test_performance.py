from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import check, log, rows

from tramwise.operators import overview, performance, routes


def logs(make, network, *given):
    return network.with_(**make(travel_time_logs=given).present())


def test_route_without_logs(make, network):
    t = logs(make, network, log(1))
    kept = {r["route_name"]: r for r in rows(routes.all_routes(t))}
    assert set(kept) == {"one", "two", "loop"}
    assert kept["two"]["avg_travel_time_min"] is None
    assert [r["route_name"] for r in rows(performance.peak_vs_offpeak(t))] == ["one"]
    stats = {r["route_id"]: r for r in rows(performance.route_stats(t))}
    assert stats[2]["days_tracked"] == 0 and stats[2]["avg_delay_min"] is None
    summary = {r["route_id"]: r for r in rows(performance.route_summary(t))}
    assert summary[2]["near_capacity_trips"] == 0
    assert summary[2]["peak_hour_trips"] == 0


def test_mean_on_the_edge_rounds_away_from_zero(make, network):
    pair = [log(1, avg_travel_time="1.00"), log(1, avg_travel_time="1.01")]
    t = logs(make, network, *pair)
    found = rows(routes.all_routes(t))
    assert found[1]["avg_travel_time_min"] == Decimal("1.01")
    t = logs(make, network, *[log(1, delay=-d) for d in [1] * 199 + [2]])
    assert rows(performance.weather_impact(t))[0]["avg_delay"] == Decimal("-1.01")


def test_means_equal_exact_arithmetic(spark):
    """Random groups against fractions rounded half away from zero."""
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F

    from tramwise.functions.stats import rounded_mean

    draw = random.Random(5)
    groups = {
        g: [draw.randint(-300, 300) for _ in range(draw.choice([1, 3, 7, 8, 40, 200]))]
        for g in range(1500)
    }
    given = [(g, v) for g, values in groups.items() for v in values]
    frame = spark.createDataFrame(given, "g INT, v INT").repartition(6)
    found = frame.groupBy("g").agg(rounded_mean(F.col("v")).alias("m")).collect()
    for row in found:
        exact = Fraction(sum(groups[row["g"]]), len(groups[row["g"]])) * 100
        size = (2 * abs(exact) + 1) // 2
        assert row["m"] * 100 == (size if exact >= 0 else -size)


def test_long_sums_stay_exact(spark, make, network):
    t = logs(make, network, log(1, avg_travel_time="999.99"))
    many = t.with_(
        travel_time_logs=t.travel_time_logs.crossJoin(spark.range(200_000)).drop("id")
    )
    found = rows(performance.weather_impact(many))[0]
    assert found["avg_duration"] == Decimal("999.99") and found["trip_count"] == 200_000


def test_one_log_has_no_deviation(make, network):
    t = logs(make, network, log(1))
    assert rows(performance.weather_by_route(t))[0]["delay_std_dev"] is None


def test_unknown_peak_flag_counts_for_neither(make, network):
    t = logs(make, network, log(1), log(1, is_peak_hour=None))
    found = {r["route_id"]: r for r in rows(performance.route_summary(t))}[1]
    assert (found["peak_hour_trips"], found["offpeak_trips"]) == (1, 0)
    daily = rows(performance.daily_metrics(t))[0]
    assert (daily["total_trips"], daily["peak_trips"]) == (2, 1)


def test_capacity_zero(make, network):
    t = logs(make, network, log(3))
    found = {r["route_id"]: r for r in rows(performance.route_stats(t))}[3]
    assert found["utilization_percent"] is None
    assert rows(performance.hourly_patterns(t))[0]["avg_utilization"] is None


def test_near_capacity(make, network):
    t = logs(make, network, log(1, passenger_count=53), log(1, passenger_count=54))
    found = {r["route_id"]: r for r in rows(performance.route_summary(t))}[1]
    assert found["near_capacity_trips"] == 1


def test_delay_categories(make, network):
    given = [log(1, delay=d, log_id=i) for i, d in enumerate([0, 5, 6, 15, 16, None])]
    t = logs(make, network, *given)
    t = t.with_(**make(service_availability=[]).present())
    found = {r["log_id"]: r for r in rows(performance.route_performance_export(t))}
    assert [found[i]["delay_category"] for i in range(6)] == [
        "On Time",
        "Slight Delay",
        "Moderate Delay",
        "Moderate Delay",
        "Severe Delay",
        "Severe Delay",
    ]


def test_two_checks_in_the_hour_give_two_rows(make, network):
    t = logs(make, network, log(1, minute=485), log(2, minute=485))
    checks = [
        check(1, 1, "2000-01-03 08:00:00"),
        check(2, 1, "2000-01-03 08:59:59"),
        check(3, 1, "2000-01-03 09:00:00"),
        check(4, 1, "2000-01-02 08:10:00"),
    ]
    t = t.with_(**make(service_availability=checks).present())
    found = rows(performance.route_performance_export(t))
    assert sorted(r["route_id"] for r in found) == [1, 1, 2]
    assert [r["service_status"] for r in found if r["route_id"] == 2] == [None]


def test_weekdays_count_from_sunday(make, network):
    days = [log(1, day=date(2000, 1, 1)), log(1, day=date(2000, 1, 2))]
    found = rows(performance.daily_metrics(logs(make, network, *days)))
    assert {r["day"]: r["day_of_week"] for r in found} == {1: 6, 2: 0}


def test_weather_of_the_day(make, network):
    kinds = ["Rain", "Clear", "Clear", None, None, None]
    t = logs(make, network, *[log(1, weather_condition=k) for k in kinds])
    found = rows(performance.daily_metrics(t, modal_weather=True))[0]
    assert found["predominant_weather"] == "Rain"
    assert found["modal_weather"] == "Clear"
    assert found["total_trips"] == 6


def test_daily_counts_sum_to_the_logs(spark):
    from tramwise.sources import star

    t = star.tables(spark, "/root/testdata/sf0.001")
    total = performance.daily_metrics(t, sort=False).agg({"total_trips": "sum"})
    assert total.first()[0] == t.travel_time_logs.count()


def test_trend_keeps_the_bound_and_later_days(make, network):
    days = [date(2000, 1, 1), date(2000, 1, 2), date(2000, 3, 1)]
    t = logs(make, network, *[log(1, day=d) for d in days])
    as_of = datetime(2000, 2, 1, 12)
    found = rows(performance.travel_time_trends(t, 1, days=30, as_of=as_of))
    assert [r["log_date"] for r in found] == days[1:]
    assert "route_id" not in found[0]
    assert rows(performance.travel_time_trends(t, 2, days=30, as_of=as_of)) == []


def test_unknown_weather_is_a_group(make, network):
    given = [log(1, weather_condition=w) for w in ("Clear", None, None)]
    t = logs(make, network, *given)
    counts = {
        r["weather_condition"]: r["trip_count"] for r in rows(performance.weather_impact(t))
    }
    assert counts == {"Clear": 1, None: 2}
    shares = {r["weather_condition"]: r["share"] for r in rows(performance.weather_share(t))}
    assert shares[None] == pytest.approx(2 / 3)
    assert rows(performance.weather_impact(t, route_id=2)) == []


def test_nulls_come_first_in_falling_order(make, network):
    t = logs(make, network, log(1, delay=9), log(2, delay=3, is_peak_hour=False))
    found = [r["route_name"] for r in rows(performance.peak_vs_offpeak(t))]
    assert found == ["two", "one"]


def test_traffic_light(make, network):
    light = {
        r["route_id"]: r["light"]
        for r in rows(
            routes.delay_traffic_light(
                logs(make, network, log(1, delay=5), log(2, delay=4), log(3, delay=10))
            )
        )
    }
    assert light == {1: "yellow", 2: "green", 3: "red"}
    t = logs(make, network, log(1))
    unmeasured = rows(routes.delay_traffic_light(t))[1]
    assert unmeasured["light"] == "red"


def test_kpis_leave_unmeasured_routes_out_of_the_mean(make, network):
    t = logs(make, network, log(1, avg_travel_time="10"), log(2, avg_travel_time="30"))
    found = rows(overview.system_kpis(t))[0]
    assert found["avg_travel_time"] == 20.0
    assert found["total_capacity"] == 260
    assert found["total_distance_km"] == Decimal("16.50")


def test_fare_bands(make, network):
    t = logs(make, network, log(1))
    found = rows(overview.fare_histogram(t, bins=4))
    assert [(r["bin"], r["lo"], r["hi"], r["n"]) for r in found] == [
        (0, 2.0, 2.25, 2),
        (1, 2.25, 2.5, 0),
        (2, 2.5, 2.75, 0),
        (3, 2.75, 3.0, 1),
    ]
    same = t.with_(routes=t.routes.filter("base_fare = 2"))
    assert [(r["bin"], r["n"]) for r in rows(overview.fare_histogram(same))] == [(0, 2)]
