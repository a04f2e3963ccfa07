import json
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import log, rows

from tramwise.functions.calendar import weekday_name
from tramwise.operators import ingest, timetable
from tramwise.operators.audit import integrity_audit
from tramwise.plans.importer import import_network
from tramwise.schema import STATION_FEED, STATIONS, STOP_LISTS
from tramwise.sources import feed


def station(number, borough="Bronx", name=None, ada="1"):
    return {
        "station_id": str(number),
        "stop_name": name or f"stop {number:03d}",
        "borough": borough,
        "gtfs_latitude": "40.123456",
        "gtfs_longitude": "-73.5",
        "ada": ada,
    }


def raw(spark, *stations):
    return spark.createDataFrame([tuple(s.values()) for s in stations], STATION_FEED)


def test_landed_files(spark, tmp_path):
    given = [station(1), {"station_id": "2", "other": 1}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, given)))
    (tmp_path / "array.json").write_text(json.dumps(given))
    lines = feed.read_feed(spark, str(tmp_path / "lines.json"))
    array = feed.read_feed(spark, str(tmp_path / "array.json"), array=True)
    assert rows(lines) == rows(array)
    cleaned = rows(ingest.clean_feed(lines))
    assert cleaned[0]["stop_lat"] == "40.123456"
    assert cleaned[1]["stop_name"] is None
    text = spark.createDataFrame([(json.dumps(g),) for g in given], "value STRING")
    assert rows(feed.parse_feed(text)) == rows(lines)


def test_missing_column(spark):
    with pytest.raises(ingest.MissingColumns, match="ada"):
        ingest.clean_feed(raw(spark, station(1)).drop("ada"))


def test_first_row_of_a_key(spark):
    twice = raw(spark, station(1, name="b"), station(1, name="a"), station(2))
    found = {r["station_id"]: r["stop_name"] for r in rows(ingest.distinct_stations(twice))}
    assert found == {"1": "a", "2": "stop 002"}


def test_sample_sizes_and_repeatability(spark):
    boroughs = ["Bronx", "Brooklyn", "Queens", "Manhattan", "Staten Island"]
    many = [station(i, boroughs[i % 5]) for i in range(65)]
    cleaned = ingest.clean_feed(raw(spark, *many, station(99, None)))
    def drawn(frame, **how):
        return sorted(rows(ingest.stratified_sample(frame, 12, **how)), key=str)

    sizes = [sum(r["borough"] == b for r in drawn(cleaned)) for b in boroughs]
    assert sizes == [12] * 5
    assert drawn(cleaned.repartition(7)) == drawn(cleaned)
    assert drawn(cleaned, seed=7) != drawn(cleaned)


def test_faulty_rows_are_set_aside(spark, network):
    from tramwise.sources import feed

    good = '{"station_id": "1", "stop_name": "A", "borough": "x", "ada": "1", "gtfs_latitude": "1.5"}'
    no_place = '{"station_id": "2", "stop_name": "B", "gtfs_latitude": "", "gtfs_longitude": "1"}'
    no_name = '{"station_id": "3"}'
    odd_mark = '{"station_id": "4", "stop_name": "D", "ada": "yes"}'
    lines = spark.createDataFrame(
        [(t,) for t in (good, no_place, no_name, odd_mark, "{broken", "{broken")], "value string"
    )
    parsed = feed.parse_feed(lines)
    loaded = rows(ingest.import_stations(parsed, network.zones))
    assert sorted(r["station_name"] for r in loaded) == ["A", "D"]
    assert {r["station_name"]: r["wheelchair_accessible"] for r in loaded} == {"A": True, "D": False}
    faults = [r["fault"] for r in rows(ingest.feed_rejects(parsed))]
    assert sorted(faults) == ["bad stop_lat", "no station_id", "no station_id", "no stop_name"]


def test_too_many_buckets_are_refused(spark):
    with pytest.raises(ValueError):
        ingest.surrogate_keys(spark.range(3), "id", "number", digits=6)


def test_ids_are_gapless_and_keep_every_row(spark):
    keyed = ingest.surrogate_keys(
        spark.range(1000).selectExpr("if(id = 0, null, 'key ' || id) as name"),
        "name",
        "number",
    )
    assert sorted(r["number"] for r in rows(keyed)) == list(range(1, 1001))


def test_station_import(spark, network):
    given = [
        station(1, "North"),
        station(2, "Nowhere", ada=None),
        station(2, "Nowhere", name="zz", ada=None),
    ]
    found = {
        r["station_name"]: r
        for r in rows(ingest.import_stations(raw(spark, *given), network.zones))
    }
    assert len(found) == 2
    assert found["stop 001"]["zone_id"] == 1
    assert found["stop 001"]["has_elevator"] is True
    assert found["stop 001"]["wheelchair_accessible"] is True
    assert found["stop 001"]["latitude"] == Decimal("40.123456")
    assert found["stop 002"]["zone_id"] is None
    assert found["stop 002"]["has_elevator"] is False


def test_conform_fills_defaults(spark):
    given = "station_id LONG, station_name STRING, has_elevator BOOLEAN"
    some = spark.createDataFrame([(1, "x", None)], given)
    found = ingest.conform(some, "stations")
    assert found.columns == spark.createDataFrame([], STATIONS).columns
    row = rows(found)[0]
    assert row["has_elevator"] is False and row["zone_id"] is None


def test_lines(spark, network):
    given = [
        (1, "A", "metro", ["x", "A", "B", "C", "y"]),
        (2, "M15", "bus", ["C", "A"]),
        (3, "L", "one known stop", ["A", "x"]),
        (4, "N", "no stops", []),
    ]
    lines = spark.createDataFrame(given, STOP_LISTS)
    found = rows(ingest.routes_from_stop_lists(lines, network.stations).orderBy("line_id"))
    assert [
        (r["route_name"], r["transport_type"], r["start_station_id"], r["end_station_id"])
        for r in found
    ] == [("A", "Metro", 1, 3), ("M15", "Bus", 3, 1)]
    assert found[0]["base_fare"] == Decimal("2.75")


def test_timetables(network):
    imported = timetable.timetable_importer(network.routes)
    found = rows(imported)
    assert len(found) == 3 * 7 * 60
    assert len({r["schedule_id"] for r in found}) == len(found)
    monday = [r for r in found if r["route_id"] == 1 and r["day_of_week"] == "Monday"]
    carried = next(r for r in monday if r["departure_min"] == 8 * 60 + 50)
    assert carried["arrival_min"] == 9 * 60 + 15 and carried["is_peak_hour"]
    seeded = rows(timetable.timetable_seed(network.routes))
    assert len(seeded) == 3 * 7 * 46
    first = next(r for r in seeded if r["route_id"] == 2)
    assert first["arrival_min"] - first["departure_min"] == 27
    late = timetable.Headway(first=1430, last=1430, every=10, ride=25, peak=False)
    wrapped = rows(timetable.expand_timetable(network.routes, [late], days=["Monday"]))
    assert wrapped[0]["arrival_min"] == 15


def test_weekday_names(spark):
    from pyspark.sql import functions as F

    given = spark.createDataFrame([("0",), ("6",), ("Monday",), ("x",), (None,)], "d STRING")
    found = [r[0] for r in given.select(weekday_name(F.col("d"))).collect()]
    assert found == ["Sunday", "Saturday", "Monday", "x", None]


def test_whole_import(spark, network):
    boroughs = ["North", "South"]
    stations = raw(spark, *[station(i, boroughs[i % 2]) for i in range(30)])
    stops = [(1, "A", "", ["stop 001", "stop 002"]), (2, "B", "", ["stop 001"])]
    t = import_network(stations, spark.createDataFrame(stops, STOP_LISTS), network.zones)
    assert t.stations.count() == 30 and t.routes.count() == 1
    assert t.schedules.count() == 7 * 60
    findings = {(r["table_name"], r["rule"]): r["n"] for r in rows(integrity_audit(t))}
    assert findings and not any(findings.values())
    small = import_network(
        stations, spark.createDataFrame(stops, STOP_LISTS), network.zones, sample=12
    )
    assert small.stations.count() == 24


def test_schedule_and_trip_rows(spark):
    raw = spark.sql("select 5 route_id, '0' day_of_week, 60 departure_min")
    row = rows(ingest.schedule_rows(raw))[0]
    assert row["day_of_week"] == "Sunday" and row["is_peak_hour"] is False
    raw = spark.sql("select 1 trip_id, timestamp_ntz '2000-01-01 17:05:00' tap_in_time")
    row = rows(ingest.trip_rows(raw))[0]
    assert row["is_peak_hour"] is True and row["trip_date"].day == 1


def test_peak_from_the_hour(make):
    t = make(travel_time_logs=[log(1, minute=479, is_peak_hour=None)])
    assert rows(ingest.log_rows(t.travel_time_logs))[0]["is_peak_hour"] is True
    late = ingest.log_rows(t.travel_time_logs, hours=(9,))
    assert rows(late)[0]["is_peak_hour"] is False


def test_audit_finds_each_breach(make, network):
    at = datetime(2000, 1, 1, 8)
    broken = make(
        stations=[
            {"station_id": 1, "station_name": "A", "zone_id": 9},
            {"station_id": 2, "station_name": "A", "zone_id": 1},
        ],
        trips=[
            {
                "trip_id": 1,
                "route_id": 77,
                "tap_in_time": at,
                "tap_out_time": at.replace(hour=7),
                "trip_date": at.date(),
                "payment_method": "x" * 21,
            },
            {"trip_id": 1, "route_id": 1, "tap_in_time": None, "trip_date": None},
        ],
    )
    t = network.with_(**broken.present())
    found = {(r["table_name"], r["rule"]): r["n"] for r in rows(integrity_audit(t)) if r["n"]}
    assert found == {
        ("stations", "orphan:zone_id->zones"): 1,
        ("stations", "duplicate:station_name"): 1,
        ("routes", "orphan:end_station_id->stations"): 1,
        ("trips", "orphan:route_id->routes"): 1,
        ("trips", "duplicate:trip_id"): 1,
        ("trips", "null:tap_in_time"): 1,
        ("trips", "null:trip_date"): 1,
        ("trips", "length:payment_method"): 1,
        ("trips", "tap_out_before_tap_in"): 1,
    }
