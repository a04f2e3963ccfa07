"""Export pack, refresh, report access and sources."""

import csv
import json
from datetime import date, datetime
from pathlib import Path

import pytest
from conftest import check, log, rows
from pyspark.sql import functions as F

from tramwise import Transit
from tramwise.__main__ import run
from tramwise.operators.ingest import conform
from tramwise.plans.export import DATASETS, export_pack
from tramwise.plans.refresh import current, refresh
from tramwise.plans.reports import REPORTS, first_record, kept, to_records
from tramwise.sources.tables import from_parquet
from tramwise.session import checkpoint_root

AS_OF = datetime(2000, 1, 8, 12, 30, 5)


@pytest.fixture(scope="module")
def loaded(make, network):
    days = [date(2000, 1, d) for d in (3, 4)]
    return network.with_(
        **make(
            travel_time_logs=[log(r, day=d) for r in (1, 2) for d in days],
            service_availability=[check(1, 1), check(2, 1, "2000-01-03 08:20:00")],
        ).present()
    )


def read_csv(folder):
    found = []
    for part in sorted(Path(folder).glob("part-*.csv")):
        with part.open() as lines:
            found += list(csv.DictReader(lines))
    return found


def test_export_pack(loaded, tmp_path):
    manifest = rows(export_pack(loaded, str(tmp_path), AS_OF, sort=True))
    assert [r["dataset"] for r in manifest] == list(DATASETS)
    counts = {r["dataset"]: r["rows"] for r in manifest}
    assert counts["route_performance"] == 5  # one of four logs meets two checks
    assert counts["route_summary"] == counts["stations"] == 3
    for entry in manifest:
        assert entry["path"] == f"{tmp_path}/20000108_123005/{entry['dataset']}"
        assert len(read_csv(entry["path"])) == entry["rows"]
    newest = read_csv(f"{tmp_path}/20000108_123005/route_performance")
    assert newest[0]["log_date"] == "2000-01-04"
    again = rows(export_pack(loaded, str(tmp_path), AS_OF, only=["stations"], sort=False))
    assert again[0]["rows"] == 3


def test_refresh_publishes_whole_snapshots(spark, loaded, tmp_path):
    base = str(tmp_path)
    names = refresh(loaded, base, "20000101")
    assert names[:3] == ["zones", "stations", "routes"]
    old = current(spark, base)
    assert rows(old.routes.orderBy("route_id")) == rows(loaded.routes)
    partitions = Path(base, "20000101", "travel_time_logs").glob("log_date=*")
    assert len(list(partitions)) == 2

    smaller = loaded.with_(routes=loaded.routes.filter("route_id = 1"))
    refresh(smaller, base, "20000102")
    assert current(spark, base).routes.count() == 1
    # A half-written snapshot is not seen, and can be written again.
    loaded.routes.write.parquet(f"{base}/20000103/routes")
    assert current(spark, base).routes.count() == 1
    refresh(loaded, base, "20000103")
    assert current(spark, base).routes.count() == 3
    with pytest.raises(ValueError):
        refresh(loaded, base, "20000103")


def test_partial_loads_keep_the_other_tables(spark, loaded, tmp_path):
    base = str(tmp_path)
    refresh(loaded, base, "20000105")
    before = rows(Transit(current(spark, base)).route_summary())
    # Published last under an earlier stamp, and still the newest.
    smaller = loaded.routes.filter("route_id < 3")
    refresh(type(loaded)(routes=smaller), base, "19991231")
    stored = current(spark, base)
    assert stored.routes.count() == 2
    assert rows(Transit(stored).route_summary()) == [r for r in before if r["route_id"] < 3]


def test_landed_facts_are_loaded(spark, make, loaded, tmp_path, capsys):
    base, raw = str(tmp_path / "base"), str(tmp_path / "raw")
    refresh(loaded, base, "1")
    facts = make(
        trips=[
            {"trip_id": n, "card_id": 1, "route_id": 1, "tap_in_time": datetime(2000, 1, 3, 8 + n)}
            for n in range(3)
        ],
        fare_cards=[{"card_id": 1, "card_number": "CARD_000001", "card_type": "Regular"}],
    )
    facts.trips.drop("trip_date", "is_peak_hour").write.parquet(f"{raw}/trips")
    facts.fare_cards.write.parquet(f"{raw}/fare_cards")
    run(spark, ["load", "--landed", raw, "--tables", "trips", "fare_cards", "--base", base, "--as-of", "2000-02-01"])
    assert "3 trips" in capsys.readouterr().out
    run(spark, ["cards", "--base", base, "--as-of", "2000-02-02"])
    stored = current(spark, base)
    assert [r["total_trips"] for r in rows(stored.fare_cards)] == [3]
    assert sorted(r["is_peak_hour"] for r in rows(stored.trips)) == [False, False, True]
    assert stored.travel_time_logs.count() == 4


def test_records_are_complete(spark, loaded):
    assert len(to_records(spark.range(2500))) == 2500
    assert len(to_records(spark.range(2500), 7)) == 7


def test_stored_logs_are_pruned_by_date(spark, loaded, tmp_path):
    refresh(loaded, str(tmp_path), "1")
    trend = Transit(current(spark, str(tmp_path))).travel_time_trends(
        1, days=4, as_of=AS_OF, sort=False
    )
    plan = trend._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert "EqualTo(route_id,1)" in plan
    assert len(rows(trend)) == 1


def test_stored_checks_lie_in_order_of_time(spark, make, tmp_path):
    many = make(service_availability=[check(n, n % 5, f"2000-01-{1 + n % 28:02} 08:00:00") for n in range(400)])
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        refresh(many, str(tmp_path), "1")
    finally:
        spark.conf.set(merging, "true")
    stored = current(spark, str(tmp_path)).service_availability
    spans = sorted(
        (r["first"], r["last"])
        for r in stored.groupBy(F.input_file_name().alias("file"))
        .agg(F.min("check_time").alias("first"), F.max("check_time").alias("last"))
        .collect()
    )
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_plain_parquet_tables(spark, loaded, tmp_path):
    loaded.routes.drop("active").write.parquet(f"{tmp_path}/routes")
    t = from_parquet(spark, str(tmp_path), ["routes"])
    with pytest.raises(AttributeError):
        t.stations  # noqa: B018
    with pytest.raises(TypeError):
        t.with_(buses=t.routes)
    assert {r["active"] for r in rows(t.routes)} == {None}


def test_reports_by_name(loaded, spark):
    transit = Transit(loaded)
    assert set(REPORTS) <= set(dir(transit))
    board = transit.records("status_board", limit=2)
    assert len(board) == 2 and set(board[0]) >= {"Route", "Status"}
    assert transit.records("all_routes", wheelchair_only=True)
    assert first_record(transit.route_stats(1))["days_tracked"] == 2
    assert first_record(transit.route_stats(99)) == {}
    assert to_records(transit.all_stations(), 1) == [{"station_name": "A"}]
    with pytest.raises(AttributeError):
        transit.nothing()


def test_command_line(spark, loaded, tmp_path, capsys):
    base, out = str(tmp_path / "base"), str(tmp_path / "out")
    stops = [f"stop {n}" for n in range(4)]
    feed = [
        {"station_id": str(n), "stop_name": s, "borough": "Queens", "ada": "1"}
        | {"gtfs_latitude": "40.5", "gtfs_longitude": "-73.5"}
        for n, s in enumerate(stops)
    ]
    (tmp_path / "feed.json").write_text("\n".join(map(json.dumps, feed)))
    line = {"line_id": 1, "line": "Q", "description": "", "stops": stops}
    (tmp_path / "lines.json").write_text(json.dumps(line))
    files = ["--feed", f"{tmp_path}/feed.json", "--lines", f"{tmp_path}/lines.json"]
    run(spark, ["import", *files, "--base", base, "--as-of", "2000-01-01"])
    assert "420 schedules" in capsys.readouterr().out
    run(spark, ["report", "all_stations", "--base", base, "--limit", "1"])
    shown = capsys.readouterr().out.splitlines()
    assert shown[0] == "{'station_name': 'stop 0'}" and "only the first 1 rows" in shown[1]

    refresh(loaded, base, "20000102")
    moment = ["--base", base, "--as-of", AS_OF.isoformat()]
    run(spark, ["report", "service_reliability", "--set", "days=9", *moment])
    assert "'total_checks': 2" in capsys.readouterr().out
    run(spark, ["export", "--out", out, *moment])
    assert len(capsys.readouterr().out.splitlines()) == len(DATASETS)


def test_a_crowded_date_is_stored_by_several_tasks(spark, network, tmp_path):
    crowd = spark.range(0, 100_000, 1, 8).selectExpr(
        "id as log_id", "id % 7 as route_id", "date '2000-01-03' as log_date"
    )
    many = conform(crowd, "travel_time_logs")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    try:
        refresh(network.with_(travel_time_logs=many), str(tmp_path), "1")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list(Path(tmp_path, "1", "travel_time_logs").glob("log_date=*/*.parquet"))
    assert len(files) > 1


def test_queries_in_sql(loaded, make):
    at = datetime(2000, 1, 3, 8)
    trip = {"trip_id": 1, "card_id": 4, "route_id": 2, "tap_in_time": at}
    transit = Transit(loaded.with_(**make(trips=[trip]).present()))
    named = transit.query("select route_name from routes where route_id = :id", id=2)
    assert rows(named) == [{"route_name": "two"}]
    view = transit.query("select unique_riders from route_performance where route_id = 2")
    assert rows(view) == [{"unique_riders": 1}]


def test_views(loaded, spark):
    loaded.register_views()
    assert spark.sql("select count(*) from zone_metadata").first()[0] == 2
    assert spark.sql("select count(*) from routes").first()[0] == 3


def test_kept_frames_are_released(loaded):
    with kept(loaded.travel_time_logs) as logs:
        assert logs.is_cached
        assert Transit(loaded.with_(travel_time_logs=logs)).weather_impact().count() == 1
    assert not loaded.travel_time_logs.is_cached


def test_checkpoint_folder_comes_from_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        assert checkpoint_root(spark, "/x") == "/x"
        with pytest.raises(ValueError):
            checkpoint_root(spark)
    else:
        assert checkpoint_root(spark, "/x") == given
