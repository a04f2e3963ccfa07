from conftest import rows

from tramwise.operators import routes, stations, timetable
from tramwise.operators.audit import integrity_audit
from tramwise.operators.ingest import routes_from_stop_lists
from tramwise.sources import seed


def test_demo_network(spark, make):
    t = seed.demo_network(spark)
    t = t.with_(**make(travel_time_logs=[]).present())
    assert len(rows(routes.all_routes(t))) == 10
    assert not any(r["n"] for r in rows(integrity_audit(t)))
    assert timetable.timetable_seed(t.routes).count() == 3220
    best = rows(stations.station_connectivity(t))[0]
    assert (best["station_name"], best["total_connections"]) == ("Central Station", 4)
    found = rows(routes.reachable_stations(t, "Central Station"))
    assert [r["station_name"] for r in found] == [
        "Airport Link",
        "East Terminal",
        "Tech Campus",
    ]


def test_boroughs_and_lines(spark):
    assert [r["zone_id"] for r in rows(seed.borough_zones(spark))] == [1, 2, 3, 4, 5]
    lines = seed.stop_lists(spark, [("A", "first", ["Airport Link", "North Park"])])
    t = seed.demo_network(spark)
    found = rows(routes_from_stop_lists(lines, t.stations))
    assert (found[0]["start_station_id"], found[0]["end_station_id"]) == (12, 3)
