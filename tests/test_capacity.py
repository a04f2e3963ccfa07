from datetime import datetime

import pytest
from conftest import rows

from tramwise.operators import capacity, common

AT = datetime(2025, 7, 7, 10, 15)
LATER = datetime(2025, 7, 7, 11, 0)


def seats(t, **params):
    found = rows(capacity.seats_available(t, AT, **params))
    return {r["route_name"]: r["seats_available"] for r in found}


@pytest.fixture(scope="module")
def legacy(make):
    return make(
        transport_routes=[
            {"route_id": 1, "route_name": "Route A", "max_capacity": 50},
            {"route_id": 2, "route_name": "Route B", "max_capacity": 50},
            {"route_id": 3, "route_name": "Route C", "max_capacity": 1},
        ],
        users=[{"user_id": 7, "name": "someone"}],
        passenger_logs=[
            {"route_id": 1, "ts": AT, "passenger_count": 20},
            {"route_id": 1, "ts": AT, "passenger_count": 5},
            {"route_id": 1, "ts": LATER, "passenger_count": 90},
            {"route_id": 2, "ts": AT, "passenger_count": 50},
        ],
        bookings=[
            {"booking_id": 1, "user_id": 7, "route_id": 1, "ts": AT},
            {"booking_id": 2, "user_id": 7, "route_id": 1, "ts": AT},
            {"booking_id": 3, "user_id": 7, "route_id": 2, "ts": AT},
            {"booking_id": 4, "user_id": 7, "route_id": 3, "ts": AT},
            {"booking_id": 5, "user_id": 8, "route_id": 3, "ts": LATER},
        ],
    )


def test_seats_literal_and_exact(legacy):
    # A: two logs times two bookings make four joined rows.
    assert seats(legacy) == {"Route A": 50 - 50 - 4, "Route B": -1, "Route C": 0}
    exact = seats(legacy, exact=True)
    assert exact == {"Route A": 50 - 25 - 2, "Route B": -1, "Route C": 0}
    assert seats(legacy, route_name="Route B") == {"Route B": -1}


def test_seats_without_logs_or_bookings(legacy):
    quiet = legacy.with_(bookings=legacy.bookings.limit(0))
    assert seats(quiet)["Route A"] == 25
    empty = quiet.with_(passenger_logs=legacy.passenger_logs.limit(0))
    assert seats(empty)["Route A"] == 50


def test_overload(legacy):
    found = rows(capacity.overloaded_services(legacy))
    by_route = {(r["route_name"], r["timestamp"]): r for r in found}
    full = by_route["Route B", AT]
    assert (full["total_passengers"], full["available_seats"]) == (51, -1)
    assert by_route["Route A", AT]["total_passengers"] == 54
    exact = {
        (r["route_name"], r["timestamp"])
        for r in rows(capacity.overloaded_services(legacy, exact=True))
    }
    assert exact == {("Route B", AT), ("Route A", LATER)}


@pytest.mark.parametrize("exact", [False, True])
def test_overload_in_parts_that_follow_the_logs(make, monkeypatch, exact):
    """Nothing holds the groups of more rows than a part has, and the results are those of one part."""
    many = range(300)
    logs = [{"route_id": k % 7, "ts": LATER.replace(second=k % 40), "passenger_count": k} for k in many]
    booked = [{"booking_id": k, "route_id": k % 5, "ts": LATER.replace(second=k % 30)} for k in many]
    names = [{"route_id": k, "route_name": f"Route {k % 4}", "max_capacity": 60} for k in range(6)]
    t = make(transport_routes=names, passenger_logs=[*logs, {}], bookings=[*booked, {}])
    whole = sorted(map(str, rows(capacity.overloaded_services(t, exact))))
    monkeypatch.setattr(common, "PART_ROWS", 10)
    frame = capacity.overloaded_services(t, exact, sort=False)
    assert frame.rdd.getNumPartitions() == 31
    assert sorted(map(str, rows(frame))) == whole != []
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3


def test_overload_needs_logs(legacy):
    t = legacy.with_(passenger_logs=legacy.passenger_logs.filter("route_id = 9"))
    assert rows(capacity.overloaded_services(t)) == []


def test_booking_status(legacy):
    found = rows(capacity.booking_status(legacy, AT, route_id=3))
    assert found == [{"booking_status": "Sorry, no seats left."}]
    found = rows(capacity.booking_status(legacy, AT, route_id=1))
    assert found == [{"booking_status": "Seat available! Proceed to book."}]
    assert rows(capacity.booking_status(legacy, LATER, route_id=1)) == []
    assert [r["route_id"] for r in rows(capacity.booking_status(legacy, AT))] == [1, 2, 3]


def test_booking_list(legacy):
    found = rows(capacity.booking_list(legacy))
    assert [r["booking_id"] for r in found] == [1, 2, 3, 4]  # rider 8 is unknown
