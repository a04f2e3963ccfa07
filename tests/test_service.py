from datetime import datetime

from conftest import check, rows

from tramwise.operators import service

AS_OF = datetime(2000, 2, 2, 8, 10)


def with_checks(make, network, *given):
    return network.with_(**make(service_availability=given).present())


def test_latest_check_and_tie(make, network):
    t = with_checks(
        make,
        network,
        check(1, 1, "2000-01-05 10:00:00", delay=1),
        check(3, 1, "2000-01-05 10:00:00", delay=3),
        check(2, 1, "2000-01-05 10:00:00", delay=2),
        check(9, 1, "2000-01-04 10:00:00", delay=9),
    )
    found = {r["route_id"]: r for r in rows(service.current_service_status(t))}
    assert found[1]["delay_minutes"] == 3
    quiet = found[2]
    assert quiet["is_operational"] is True and quiet["delay_minutes"] == 0
    assert quiet["reason"] == "Normal Service" and quiet["check_time"] is None


def test_categories(make, network):
    t = with_checks(
        make,
        network,
        check(1, 1, delay=5, reason="Track Maintenance"),
        check(2, 2, ok=False),
        check(3, 3, delay=4, reason="maintenance"),
    )
    status = {
        r["route_id"]: (r["status"], r["reason"])
        for r in rows(service.service_status_categories(t))
    }
    assert status == {
        1: ("Maintenance", "Track Maintenance"),
        2: ("Out of Service", "Normal Service"),
        3: ("Delayed", "maintenance"),
    }
    summary = {r["status"]: r["n"] for r in rows(service.status_summary(t))}
    assert summary == {"Active": 0, "Delayed": 1, "Out of Service": 1, "Maintenance": 1}
    board = rows(service.status_board(t, ["Delayed"]))
    assert board == [
        {
            "Route": "loop",
            "Type": "Tram",
            "Status": "Delayed",
            "Delay (min)": 4,
            "Reason": "maintenance",
        }
    ]


def test_summary_covers_all_routes(spark):
    from tramwise.sources import star

    t = star.tables(spark, "/root/testdata/sf0.001")
    total = sum(r["n"] for r in rows(service.status_summary(t)))
    assert total == t.routes.count()


def test_delayed_and_cancelled(make, network):
    t = with_checks(
        make,
        network,
        check(1, 1, ok=False, delay=0),
        check(2, 1, ok=False, delay=7),
        check(3, 1, ok=False, delay=None),
        check(4, 1),
    )
    found = rows(service.service_reliability(t, as_of=AS_OF))
    assert len(found) == 1
    r = found[0]
    assert (r["total_checks"], r["active_count"]) == (4, 1)
    assert (r["delayed_count"], r["cancelled_count"]) == (1, 1)
    assert float(r["reliability_percent"]) == 25.0
    assert float(r["avg_delay_when_delayed"]) == 7.0


def test_bound_is_inclusive_and_open_above(make, network):
    t = with_checks(
        make,
        network,
        check(1, 1, "2000-01-03 08:10:00"),
        check(2, 1, "2000-01-03 08:09:59"),
        check(3, 1, "2001-01-01 00:00:00"),
    )
    found = rows(service.service_reliability(t, days=30, as_of=AS_OF))
    assert found[0]["total_checks"] == 2
    # By day the whole first day counts.
    summary = rows(service.availability_summary(t, days=30, as_of=AS_OF))
    assert sum(r["status_count"] for r in summary) == 3
    assert summary[0]["check_date"].year == 2001


def test_default_window_ends_now(make, network):
    long_ago, later = check(1, 1), check(2, 2, "2099-01-01 00:00:00")
    t = with_checks(make, network, long_ago, later)
    found = rows(service.service_reliability(t))
    assert [r["route_id"] for r in found] == [2]
    assert len(rows(service.availability_summary(t))) == 1


def test_ranking_starts_with_the_weakest(make, network):
    t = with_checks(make, network, check(1, 1), check(2, 2, ok=False))
    best_first = [r["route_id"] for r in rows(service.service_reliability(t, as_of=AS_OF))]
    weakest_first = [
        r["route_id"] for r in rows(service.reliability_ranking(t, as_of=AS_OF))
    ]
    assert best_first == [1, 2] and weakest_first == [2, 1]
