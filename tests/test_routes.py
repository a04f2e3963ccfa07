from datetime import datetime
from decimal import Decimal

import pytest
from conftest import check, log, rows

from tramwise.operators import routes, stations

AS_OF = datetime(2000, 1, 8)


def test_fan_out_is_kept_and_given_exactly(make, network):
    facts = make(
        travel_time_logs=[log(1), log(1), log(1)],
        service_availability=[
            check(1, 1),
            check(2, 1),
            check(3, 1, "1999-12-31 23:59:59"),
            check(4, 2, ok=False),
            check(5, 2, ok=False),
        ],
    )
    t = network.with_(**facts.present())
    direct = rows(routes.route_by_stations(t, "A", "B", as_of=AS_OF))
    assert [r["route_id"] for r in direct] == [1]
    assert direct[0]["active_services"] == 6 and direct[0]["active_checks"] == 2
    unmeasured = rows(routes.route_by_stations(t, "B", "C", as_of=AS_OF))[0]
    assert unmeasured["delayed_services"] == unmeasured["delayed_checks"] == 2


def test_counts_equal_the_joined_form(spark):
    """Multiplied aggregates against the join that really makes the rows."""
    from tramwise.sources import star

    t = star.tables(spark, "/root/testdata/sf0.001")
    as_of = datetime(2024, 1, 10)
    checks = t.service_availability.filter("check_time >= timestamp_ntz '2024-01-03'")
    joined = (
        t.routes.join(t.travel_time_logs.select("route_id", "log_id"), "route_id", "left")
        .join(checks.select("route_id", "is_operational"), "route_id", "left")
        .groupBy("route_id")
        .agg({"is_operational": "count"})
    )
    expected = {r[0]: r[1] for r in joined.collect()}
    found = rows(routes.route_by_stations(t, as_of=as_of))
    counted = {
        r["route_id"]: r["active_services"] + r["delayed_services"] for r in found
    }
    assert counted == expected


def test_longest_time_uses_the_mean_before_rounding(make, network):
    facts = make(
        travel_time_logs=[
            log(1, avg_travel_time=v) for v in ["10.00"] * 299 + ["10.01"] * 1
        ],
        service_availability=[],
    )
    t = network.with_(**facts.present())
    assert rows(routes.route_by_stations(t, "A", "B", 10, as_of=AS_OF)) == []
    assert len(rows(routes.route_by_stations(t, "A", "B", 11, as_of=AS_OF))) == 1
    # Never measured: dropped as soon as a longest time is asked for.
    assert rows(routes.route_by_stations(t, "B", "C", 99, as_of=AS_OF)) == []


def test_one_transfer(make, network):
    t = network.with_(**make(travel_time_logs=[log(1, delay=2)]).present())
    found = rows(routes.alternative_routes(t, "A", "C"))
    assert len(found) == 1
    journey = found[0]
    assert (journey["route1_name"], journey["route2_name"]) == ("one", "two")
    assert journey["transfer_station"] == "B"
    assert journey["total_fare"] == Decimal("5.00")
    assert journey["total_travel_time_min"] is None
    assert journey["wheelchair_accessible"] is False
    assert rows(routes.alternative_routes(t, "A", "C", wheelchair=True)) == []


def test_transfer_time_and_order(make, network):
    given = [log(1, delay=2, avg_travel_time="10.5"), log(3, avg_travel_time="4")]
    t = network.with_(**make(travel_time_logs=given).present())
    found = rows(routes.alternative_routes(t, "A", "B"))
    assert [r["route2_name"] for r in found] == ["loop"]
    assert found[0]["total_travel_time_min"] == Decimal("19.50")
    # The loop alone cannot be changed into itself.
    assert rows(routes.alternative_routes(t, "B", "B")) == []


def test_reachable(network):
    assert rows(routes.reachable_stations(network, "B")) == [
        {"station_name": "B"},
        {"station_name": "C"},
    ]
    open_to_all = routes.reachable_stations(network, "B", wheelchair=True)
    assert rows(open_to_all) == [{"station_name": "B"}]


def test_schedules_run_from_monday_and_unknown_days_last(make):
    days = ["Sunday", "Monday", "Holiday", None, "Wednesday", "Monday"]
    given = [
        {
            "route_id": 1,
            "day_of_week": day,
            "departure_min": 530 - i,
            "arrival_min": 555 - i,
            "is_peak_hour": True,
        }
        for i, day in enumerate(days)
    ]
    t = make(schedules=given)
    found = rows(routes.route_schedules(t, 1))
    assert [r["day"] for r in found][:4] == ["Monday", "Monday", "Wednesday", "Sunday"]
    assert {r["day"] for r in found[4:]} == {"Holiday", None}
    assert found[0]["departure_time"] == "08:45:00"
    assert found[0]["arrival_time"] == "09:10:00"
    assert found[0]["duration_min"] == 25
    assert len(rows(routes.route_schedules(t, 1, limit=2))) == 2
    assert [r["route_id"] for r in rows(routes.route_schedules(t, limit=3))] == [1] * 3


def test_lookup_takes_the_first_id(network):
    twice = network.with_(
        routes=network.routes.replace({"loop": "one"}, subset=["route_name"])
    )
    assert rows(routes.route_lookup(twice, "one")) == [
        {"route_id": 1, "route_name": "one"}
    ]
    assert [r["route_name"] for r in rows(routes.route_lookup(twice))] == ["one", "two"]


def test_filters(make, network):
    t = network.with_(**make(travel_time_logs=[log(1), log(2)]).present())
    assert [r["route_id"] for r in rows(routes.filter_routes(t, ["Metro"]))] == [2]
    assert rows(routes.filter_routes(t, [])) == []
    assert len(rows(routes.filter_routes(t, None, 20))) == 2
    # Zero is a limit, not "no limit".
    assert rows(routes.filter_routes(t, None, 0)) == []
    assert len(rows(routes.all_routes(t, wheelchair_only=True))) == 2


@pytest.mark.parametrize(
    ("name", "outgoing", "incoming"), [("A", 1, 0), ("B", 2, 2), ("C", 0, 1)]
)
def test_connections(network, name, outgoing, incoming):
    found = rows(stations.station_details(network, name))
    assert len(found) == 1
    assert found[0]["outgoing_routes"] == outgoing
    assert found[0]["incoming_routes"] == incoming


def test_connectivity_order(network):
    found = rows(stations.station_connectivity(network))
    assert [(r["station_name"], r["total_connections"]) for r in found] == [
        ("B", 4),
        ("A", 1),
        ("C", 1),
    ]
