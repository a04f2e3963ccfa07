"""Stable ids, loads at once, appended facts and what is derived from them."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import log, rows
from pyspark.sql import functions as F

from tramwise import Transit
from tramwise.__main__ import run
from tramwise.operators import common, ingest, performance, ridership, rollup
from tramwise.plans import refresh as loads
from tramwise.plans.export import DATASETS, export_pack
from tramwise.plans.importer import load_network
from tramwise.plans.load import with_card_statistics
from tramwise.plans.refresh import Conflict, create_only, current, maintain, parts, refresh
from tramwise.schema import STATION_FEED, STOP_LISTS
from tramwise.sources import Tables


def same(left, right):
    return sorted(map(str, rows(left))) == sorted(map(str, rows(right)))


# -- ids ----------------------------------------------------------------------


def keys_of(frame):
    return {r["k"]: r["id"] for r in frame.collect()}


def test_known_keys_keep_their_ids(spark):
    """Ten loads, each with 10 % new keys and some old ones missing."""
    draw = random.Random(3)
    known, held, names = None, {}, [f"key {n}" for n in range(100)]
    for turn in range(10):
        given = draw.sample(names, len(names) * 4 // 5) + [None]
        frame = spark.createDataFrame([(k,) for k in given * 2], "k string")
        known = ingest.stable_keys(frame, "k", "id", known)
        found = keys_of(known)
        assert found.items() >= held.items()
        assert set(found) == set(held) | set(given) - {None}
        assert sorted(found.values()) == list(range(1, len(found) + 1))
        held = found
        known = spark.createDataFrame(list(held.items()), "k string, id bigint")
        names += [f"key {turn} {n}" for n in range(len(names) // 10)]


def test_first_numbers_are_those_of_a_plain_load(spark):
    frame = spark.range(500).selectExpr("cast(id as string) k")
    plain = keys_of(ingest.surrogate_keys(frame, "k", "id"))
    assert keys_of(ingest.stable_keys(frame, "k", "id")) == plain
    empty = spark.createDataFrame([], "k string")
    assert keys_of(ingest.stable_keys(empty, "k", "id")) == {}


def feed_of(spark, numbers):
    made = [(str(n), f"stop {n}", "Queens", "40.5", "-73.5", "1") for n in numbers]
    return spark.createDataFrame(made, STATION_FEED)


def lines_of(spark, *lines):
    made = [(k, f"line {k}", "", [f"stop {n}" for n in stops]) for k, stops in lines]
    return spark.createDataFrame(made, STOP_LISTS)


def test_networks_loaded_again_keep_stations_and_routes(spark, network, tmp_path):
    base = str(tmp_path)
    first = feed_of(spark, range(40))
    load_network(first, lines_of(spark, (7, [1, 2]), (9, [3, 4])), network.zones, base, "a")
    one = current(spark, base)
    stations = {r["station_name"]: r["station_id"] for r in rows(one.stations)}
    routes = {r["route_name"]: r["route_id"] for r in rows(one.routes)}
    second = feed_of(spark, range(5, 44))
    load_network(second, lines_of(spark, (8, [41, 42]), (9, [3, 40])), network.zones, base, "b")
    two = current(spark, base)
    again = {r["station_name"]: r["station_id"] for r in rows(two.stations)}
    assert all(stations[n] == i for n, i in again.items() if n in stations)
    assert sorted(set(again.values()) - set(stations.values())) == [41, 42, 43, 44]
    held = {r["route_name"]: r["route_id"] for r in rows(two.routes)}
    assert held == {"line 8": 3}  # line 9 has one known stop: stop 3 left the feed
    load_network(first, lines_of(spark, (7, [1, 2]), (9, [5, 6])), network.zones, base, "c")
    three = {r["route_name"]: r["route_id"] for r in rows(current(spark, base).routes)}
    assert three == routes


def test_two_networks_at_once_conflict(spark, network, tmp_path, monkeypatch):
    base, plain = str(tmp_path), loads.laid_out
    lines = lines_of(spark, (7, [1, 2]))
    load_network(feed_of(spark, range(5)), lines, network.zones, base, "a")

    def other(frame, name):
        monkeypatch.setattr(loads, "laid_out", plain)
        load_network(feed_of(spark, range(9)), lines, network.zones, base, "b")
        return plain(frame, name)

    monkeypatch.setattr(loads, "laid_out", other)
    with pytest.raises(Conflict):
        load_network(feed_of(spark, [1, 2, 77]), lines, network.zones, base, "c")
    assert current(spark, base).stations.count() == 9
    load_network(feed_of(spark, [1, 2, 77]), lines, network.zones, base, "d")
    found = {r["station_name"]: r["station_id"] for r in rows(current(spark, base).stations)}
    assert found["stop 77"] == 10


# -- loads at once ------------------------------------------------------------


def test_a_load_during_a_load_is_kept(spark, network, tmp_path, monkeypatch):
    base, plain = str(tmp_path), loads.laid_out
    refresh(network, base, "0")

    def other(frame, name):
        monkeypatch.setattr(loads, "laid_out", plain)
        refresh(Tables(zones=network.zones.limit(1)), base, "2")
        return plain(frame, name)

    monkeypatch.setattr(loads, "laid_out", other)
    refresh(Tables(routes=network.routes.limit(2)), base, "1")
    stored = current(spark, base)
    assert (stored.zones.count(), stored.routes.count(), stored.stations.count()) == (1, 2, 3)


def test_a_taken_number_is_built_on(spark, network, tmp_path, monkeypatch):
    """Two loads that saw the same newest record."""
    base, plain = str(tmp_path), loads._newest
    refresh(network, base, "0")
    stale = plain(spark, base)
    refresh(Tables(zones=network.zones.limit(1)), base, "1")
    answers = [stale]
    monkeypatch.setattr(loads, "_newest", lambda *a: answers.pop() if answers else plain(*a))
    refresh(Tables(routes=network.routes.limit(2)), base, "2")
    stored = current(spark, base)
    assert (stored.zones.count(), stored.routes.count()) == (1, 2)
    assert len(list(Path(base, "_commits").glob("*.json"))) == 3


def test_a_dead_record_is_passed_over(spark, network, tmp_path, monkeypatch):
    monkeypatch.setattr(loads, "PATIENCE", 0.0)
    base = str(tmp_path)
    refresh(network, base, "0")
    assert create_only(spark, f"{base}/_commits/{1:012d}.json", '{"number": 1, "sta')
    assert not create_only(spark, f"{base}/_commits/{1:012d}.json", "{}")
    refresh(Tables(routes=network.routes.limit(1)), base, "1")
    assert current(spark, base).routes.count() == 1


# -- derived tables -----------------------------------------------------------


def some_trips(make, seed, n=300):
    draw = random.Random(seed)
    made = []
    for k in range(n):
        at = datetime(2000, 1, 1, draw.randrange(24)) + timedelta(days=draw.randrange(40))
        card = draw.choice([None, 1, 2, 3, 40_000, 70_000, *range(5, 30)])
        made.append(
            {"trip_id": seed * 1000 + k, "card_id": card, "route_id": draw.choice([1, 1, 2, None])}
            | {"tap_in_time": at, "trip_date": at.date(), "fare_paid": draw.choice([None, Decimal("2.00"), Decimal("3.25")])}
        )
    return make(trips=made).trips


def some_logs(make, seed, n=200):
    draw = random.Random(seed)
    weathers = [None, "Rain", "Sunny"]
    return make(
        travel_time_logs=[
            log(
                draw.choice([1, 2]),
                log_id=seed * 1000 + k,
                day=date(2000, 1, 1 + draw.randrange(9)),
                log_min=draw.randrange(1440),
                passenger_count=draw.choice([None, *range(0, 120, 7)]),
                delay_minutes=draw.choice([None, *range(-2, 20)]),
                is_peak_hour=draw.choice([None, True, False]),
                weather_condition=draw.choice(weathers),
            )
            for k in range(n)
        ]
    ).travel_time_logs


LOG_REPORTS = (
    "route_summary",
    "route_stats",
    "peak_vs_offpeak",
    "weather_impact",
    "daily_metrics",
    "hourly_patterns",
    "weather_by_route",
)
TRIP_REPORTS = ("daily_ridership", "route_performance", "peak_hour_analysis", "card_statistics")


@pytest.fixture(scope="module")
def appended(spark, make, network, tmp_path_factory):
    """Three loads of logs and trips, of which two have their sums stored."""
    base = str(tmp_path_factory.mktemp("appended"))
    cards = make(
        fare_cards=[{"card_id": c, "card_number": str(c), "total_trips": 5} for c in (1, 2, 9, 70_000, 80_000)]
    ).fare_cards
    refresh(network.with_(fare_cards=cards), base, "dims")
    for k in range(3):
        facts = Tables(trips=some_trips(make, k), travel_time_logs=some_logs(make, k))
        refresh(facts, base, f"load{k}", append=("trips", "travel_time_logs"))
        if k < 2:
            maintain(spark, base)
    return base


@pytest.mark.parametrize("name", LOG_REPORTS + TRIP_REPORTS)
def test_sums_of_several_loads_give_the_reports(spark, appended, name):
    stored = current(spark, appended)
    assert parts(spark, appended)["trips"] == ["load0", "load1", "load2"]
    assert parts(spark, appended)["card_counts"] == ["load0", "load1"]
    direct = performance if name in LOG_REPORTS else ridership
    assert same(getattr(rollup, name)(stored), getattr(direct, name)(stored))


def test_riders_of_a_range_of_days(spark, appended):
    stored = current(spark, appended)
    since, until = date(2000, 1, 10), date(2000, 1, 25)
    some = stored.with_(trips=stored.trips.filter(F.col("trip_date").between(since, until)))
    for name in TRIP_REPORTS[:3]:
        assert same(getattr(rollup, name)(stored, since, until), getattr(ridership, name)(some))


def test_rider_sets_are_words_in_parts_that_follow_the_trips(spark, make, network, monkeypatch):
    """Few riders of a day take a word each, whatever their numbers; more trips, more parts."""
    monkeypatch.setattr(common, "PART_ROWS", 50)
    cards = [None, -1, -64, -65, 0, 63, 64, 5_000_000_000, 2**63 - 1, -(2**63)]
    day = date(2000, 1, 3)
    made = [
        {"trip_id": k, "card_id": cards[k % 10], "route_id": 1 + k % 2, "trip_date": day}
        | {"tap_in_time": datetime(2000, 1, 3, k % 3)}
        for k in range(400)
    ]
    t = network.with_(trips=make(trips=made).trips)
    sets = rollup.rider_sets(t.trips)
    assert sets.rdd.getNumPartitions() == 3 * 400 / 50
    assert rollup.trip_rollup(t.trips).rdd.getNumPartitions() == 400 / 50
    assert dict(sets.dtypes)["cards"] == "bigint"
    daily = {r["bucket"]: r["cards"] for r in rows(sets.filter("grain = 'day'"))}
    assert len(daily) == 7 and daily[0] == 1 - 2**63 and daily[-1] == 1 - 2**63
    summed = t.with_(trip_rollup=rollup.trip_rollup(t.trips), rider_sets=sets)
    for name in TRIP_REPORTS[:3]:
        assert same(getattr(rollup, name)(summed), getattr(ridership, name)(t))


def test_records_of_older_derived_tables_are_passed_over(spark, make, network, tmp_path):
    base, trips = str(tmp_path), some_trips(make, 1)
    refresh(network.with_(trips=trips), base, "1")
    loads._publish(spark, base, "old", lambda tables: tables | {"rider_bitmaps": ["1"]})
    stored = current(spark, base)
    assert same(rollup.daily_ridership(stored), ridership.daily_ridership(stored))
    assert "rider_sets/1" in maintain(spark, base)


def test_only_new_snapshots_are_read(spark, make, network, tmp_path):
    base = str(tmp_path)
    refresh(Tables(trips=some_trips(make, 1)), base, "1")
    assert maintain(spark, base, ["card_counts"]) == ["card_counts/1"]
    refresh(Tables(trips=some_trips(make, 2)), base, "2", append=["trips"])
    lagging = current(spark, base).card_counts
    read = {Path(f).relative_to(base).parts[:2] if not f.startswith("file:") else tuple(f.removeprefix("file://").removeprefix(base).strip("/").split("/")[:2]) for f in lagging.inputFiles()}
    assert read == {("1", "card_counts"), ("2", "trips")}
    assert maintain(spark, base, ["card_counts"]) == ["card_counts/2"]
    assert maintain(spark, base, ["card_counts"]) == []
    assert all("/card_counts/" in f for f in current(spark, base).card_counts.inputFiles())
    refresh(Tables(trips=some_trips(make, 3)), base, "3")  # in place of all others
    assert maintain(spark, base, ["card_counts"]) == ["card_counts/3"]
    assert parts(spark, base)["card_counts"] == ["3"]


def test_card_statistics_of_loads_in_any_order(spark, make, tmp_path):
    cards = make(fare_cards=[{"card_id": c, "card_number": str(c), "total_trips": 0} for c in range(1, 30)]).fare_cards
    found = []
    for order in ((1, 2, 3), (3, 1, 2)):
        base = str(tmp_path / str(order[0]))
        refresh(Tables(fare_cards=cards), base, "cards")
        for k in order:
            refresh(Tables(trips=some_trips(make, k)), base, f"load{k}", append=["trips"])
            run(spark, ["cards", "--base", base, "--as-of", f"2000-03-0{k}"])
        stored = current(spark, base)
        found.append(stored.fare_cards)
        once = ridership.refreshed_fare_cards(stored.with_(fare_cards=cards))
        assert same(stored.fare_cards.select("card_id", "total_trips", "last_used"), once.select("card_id", "total_trips", "last_used"))
        assert all("/card_counts/" in f for f in stored.card_counts.inputFiles())
    assert same(*found)


def test_reports_from_sums_read_no_facts(spark, appended):
    maintain(spark, appended)
    stored = current(spark, appended)
    for name in LOG_REPORTS + TRIP_REPORTS:
        files = getattr(rollup, name)(stored, sort=False).inputFiles() if name != "card_statistics" else rollup.card_statistics(stored).inputFiles()
        assert not [f for f in files if "/trips/" in f or "/travel_time_logs/" in f], name
    assert same(with_card_statistics(stored).fare_cards, with_card_statistics(Tables(trips=stored.trips, fare_cards=stored.fare_cards)).fare_cards)


# -- the export pack ----------------------------------------------------------


def test_export_reads_the_logs_three_times(spark, make, network, tmp_path):
    logs = some_logs(make, 5)
    logs.write.parquet(f"{tmp_path}/logs")
    stored = spark.read.schema(logs.schema).parquet(f"{tmp_path}/logs")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = stored.mapInArrow(seen, logs.schema)
    checks = make(service_availability=[]).service_availability
    t = network.with_(travel_time_logs=watched, service_availability=checks)
    manifest = rows(export_pack(t, str(tmp_path / "out"), datetime(2000, 1, 8)))
    assert [r["dataset"] for r in manifest] == list(DATASETS)
    assert read.value <= 3 * logs.count()
    direct = network.with_(travel_time_logs=stored, service_availability=checks)
    for name in ("route_summary", "daily_metrics", "hourly_patterns"):
        path = f"{tmp_path}/out/20000108_000000/{name}"
        plain = Transit(direct)
        frame = getattr(plain, name)()
        text = [F.col(c).cast("string").alias(c) for c in frame.columns]
        assert same(spark.read.option("header", True).csv(path), frame.select(*text))


def test_export_from_stored_sums_reads_the_logs_once(spark, appended, make, tmp_path):
    maintain(spark, appended)
    stored = current(spark, appended).with_(**make(service_availability=[]).present())
    manifest = rows(export_pack(stored, str(tmp_path), datetime(2000, 1, 8)))
    assert {r["dataset"]: r["rows"] for r in manifest}["route_performance"] == 600
    for name in ("route_summary", "daily_metrics", "hourly_patterns", "weather_impact"):
        files = DATASETS[name](stored, sort=False).inputFiles()
        assert not [f for f in files if "/travel_time_logs/" in f]
