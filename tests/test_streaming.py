"""Streams against the batch reports over the same rows."""

from pyspark.sql import functions as F

import pytest
from conftest import check, rows

from tramwise.operators.ridership import daily_ridership
from tramwise.operators.service import current_service_status
from tramwise.sources import star
from tramwise.streaming import ridership, status

SF_DIR = "/root/testdata/sf0.001"


def test_live_status_equals_batch(spark, tmp_path):
    t = star.tables(spark, SF_DIR)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    stored = t.service_availability.withColumn("current_capacity", F.lit(None).cast("int"))
    stored.repartition(4).write.parquet(landed)

    def run():
        stream = status.read_checks(spark, landed, files_per_batch=1)
        query = status.start_live_status(
            stream, out, str(tmp_path / "checkpoint"), snapshot_every=2
        )
        assert query.awaitTermination(120)

    run()
    live = t.with_(service_availability=status.current_status(spark, out))
    assert rows(current_service_status(live)) == rows(current_service_status(t))

    # A restart goes on where it stopped; late and old checks are told apart.
    later = [check(10**9, 1, "2030-01-01 00:00:00", ok=False, delay=3, reason="Flood")]
    older = [check(10**9 + 1, 2, "1990-01-01 00:00:00", ok=False)]
    names = [f.name for f in stored.schema if f.name != "current_capacity"]
    more = [tuple(r[n] for n in names) for r in later + older]
    schema = stored.drop("current_capacity").schema
    extra = spark.createDataFrame(more, schema)
    extra.withColumn("current_capacity", F.lit(None).cast("int")).select(
        stored.columns
    ).write.mode("append").parquet(landed)
    run()
    live = t.with_(service_availability=status.current_status(spark, out))
    kinds = spark.read.parquet(f"{out}/run=0").select("kind", "batch_id").distinct()
    assert {tuple(r) for r in kinds.collect()} >= {("snapshot", 2), ("change", 3)}
    both = t.with_(service_availability=t.service_availability.unionByName(extra))
    assert rows(current_service_status(live)) == rows(current_service_status(both))


def test_live_status_goes_on_with_a_new_checkpoint(spark, make, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(*checks):
        frame = make(service_availability=list(checks)).service_availability
        frame.coalesce(1).write.mode("append").parquet(landed)

    def run(checkpoint, source):
        stream = status.read_checks(spark, source, files_per_batch=1)
        query = status.start_live_status(stream, out, str(tmp_path / checkpoint), snapshot_every=3)
        assert query.awaitTermination(120)
        return {r["route_id"]: r["availability_id"] for r in rows(status.current_status(spark, out))}

    for n in range(4):
        land(check(n, 1, f"2000-01-03 08:1{n}:00"))
    assert run("one", landed) == {1: 3}
    land(check(5, 2, "2000-01-03 08:15:00"))
    landed2 = str(tmp_path / "landed2")
    make(service_availability=[check(9, 1, "2000-01-03 08:19:00")]).service_availability.write.parquet(landed2)
    assert run("one", landed) == {1: 3, 2: 5}
    assert run("two", landed2) == {1: 9, 2: 5}
    make(service_availability=[check(4, 2, "2000-01-03 08:14:00")]).service_availability.write.mode("append").parquet(landed2)
    assert run("two", landed2) == {1: 9, 2: 5}


def test_daily_ridership_equals_batch_on_closed_days(spark, tmp_path):
    t = star.tables(spark, SF_DIR)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    # Days arrive roughly in order, in several files.
    t.trips.repartitionByRange(4, "tap_in_time").sortWithinPartitions(
        "tap_in_time"
    ).write.parquet(landed)
    stream = ridership.read_taps(spark, landed)
    query = ridership.start_daily_ridership(stream, out, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(180)
    found = {r["trip_date"]: r for r in rows(spark.read.parquet(out))}
    expected = {r["trip_date"]: r for r in rows(daily_ridership(t))}
    last = max(expected)
    closed = {d: r for d, r in expected.items() if (last - d).days > 2}
    assert closed and set(closed) <= set(found)
    for day, row in found.items():
        assert row["total_trips"] == expected[day]["total_trips"]
        assert row["unique_riders"] == expected[day]["unique_riders"]
        assert row["total_revenue"] == expected[day]["total_revenue"]
        assert row["avg_fare"] == expected[day]["avg_fare"]


def test_late_taps_count_until_their_day_closes(spark, make, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")

    def arrive(*taps):
        trips = [
            {
                "trip_id": i,
                "card_id": card,
                "route_id": 1,
                "tap_in_time": datetime.fromisoformat(at),
                "fare_paid": Decimal("2.00"),
                "trip_date": date.fromisoformat(at[:10]),
            }
            for i, (card, at) in enumerate(taps)
        ]
        make(trips=trips).trips.coalesce(1).write.mode("append").parquet(landed)
        stream = ridership.read_taps(spark, landed, files_per_batch=1)
        query = ridership.start_daily_ridership(stream, out, str(tmp_path / "state"))
        assert query.awaitTermination(120)

    arrive((1, "2000-01-01 08:00:00"), (1, "2000-01-01 18:00:00"))
    arrive((2, "2000-01-02 09:00:00"))
    arrive((3, "2000-01-01 23:00:00"))  # a day late, but the first is still open
    arrive((2, "2000-01-05 09:00:00"))
    arrive((4, "2000-01-01 10:00:00"), (2, "2000-01-09 09:00:00"))  # too late
    found = {r["trip_date"].day: r for r in rows(spark.read.parquet(out))}
    assert found[1]["total_trips"] == 3 and found[1]["unique_riders"] == 2
    assert found[2]["total_trips"] == 1
    assert found[1]["total_revenue"] == Decimal("6.00")


def test_late_taps_are_counted_and_reconciled(spark, make, tmp_path):
    from datetime import datetime
    from decimal import Decimal

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    listener = ridership.LateTaps()
    spark.streams.addListener(listener)

    def arrive(*taps):
        trips = [
            {"trip_id": i, "card_id": card, "route_id": 1, "fare_paid": Decimal("2.00")}
            | {"tap_in_time": datetime.fromisoformat(at), "trip_date": datetime.fromisoformat(at).date()}
            for i, (card, at) in enumerate(taps)
        ]
        make(trips=trips).trips.coalesce(1).write.mode("append").parquet(landed)
        stream = ridership.read_taps(spark, landed, files_per_batch=1)
        query = ridership.start_daily_ridership(stream, out, str(tmp_path / "state"))
        assert query.awaitTermination(120)
        return query

    arrive((1, "2000-01-01 08:00:00"), (1, "2000-01-01 18:00:00"))
    arrive((2, "2000-01-02 09:00:00"))
    arrive((2, "2000-01-06 09:00:00"))
    arrive((4, "2000-01-01 10:00:00"), (1, "2000-01-01 11:00:00"), (2, "2000-01-02 01:00:00"))  # late
    query = arrive((2, "2000-01-09 09:00:00"))
    stored = spark.read.parquet(landed)
    expected = {r["trip_date"]: r for r in rows(daily_ridership(star.Tables(trips=stored)))}
    before = {r["trip_date"].day: r for r in rows(ridership.closed_days(spark, out))}
    assert (before[1]["total_trips"], before[1]["late_trips"]) == (2, 0)
    late = {r["trip_date"].day: r["late_trips"] for r in rows(ridership.late_days(stored, out))}
    assert late == {1: 2, 2: 1}
    for run in (0, 1):  # a second run finds and states the same
        ridership.reconcile(stored, out, run)
        found = rows(ridership.closed_days(spark, out))
        assert {r["trip_date"].day: r["late_trips"] for r in found if r["late_trips"]} == late
        for row in found:
            assert row | expected[row["trip_date"]] == row
    spark.streams.removeListener(listener)
    assert listener.dropped.get(str(query.id), 0) >= 2


@pytest.mark.parametrize("files_per_batch", [1, 3, 100])
def test_stations_of_a_stream_equal_the_batch(spark, network, tmp_path, files_per_batch):
    """In any split of the files, over restarts."""
    import json
    import random

    from tramwise.operators.ingest import feed_rejects, import_stations
    from tramwise.sources import feed
    from tramwise.streaming import stations

    draw = random.Random(5)
    (tmp_path / "landed").mkdir()
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    zones = ("North", "South", None)
    for turn in range(3):
        for k in range(3):
            lines = []
            for _ in range(12):
                n = draw.randrange(30)
                row = {"station_id": str(n), "stop_name": f"stop {n} {draw.choice('abc')}", "borough": draw.choice(zones)}
                row |= {"gtfs_latitude": draw.choice(["1.5", "x", "2.25"]), "gtfs_longitude": "3", "ada": draw.choice(["0", "1", None])}
                lines.append(json.dumps({c: v for c, v in row.items() if v is not None}))
            lines.append('{"stop_name": "without an id"}')
            (tmp_path / "landed" / f"{turn}-{k}.json").write_text("\n".join(lines))
        queries = stations.start_stations(
            stations.read_feed(spark, landed, files_per_batch), out, str(tmp_path / "state")
        )
        for query in queries:
            assert query.awaitTermination(180)
        if turn == 0:
            first = {r["station_name"]: r["station_id"] for r in rows(stations.current_stations(spark, out, network.zones))}
    raw = feed.read_feed(spark, f"{landed}/*.json")
    found = rows(stations.current_stations(spark, out, network.zones))
    expected = rows(import_stations(raw, network.zones))

    def plain(stated):
        return sorted(str({c: v for c, v in r.items() if c != "station_id"}) for r in stated)

    assert plain(found) == plain(expected)
    assert sorted(r["station_id"] for r in found) == list(range(1, len(found) + 1))
    kept = {r["station_name"]: r["station_id"] for r in found}
    assert all(kept[name] == i for name, i in first.items() if name in kept)
    rejects = spark.read.parquet(f"{out}/rejects")
    assert sorted(map(str, rows(rejects))) == sorted(map(str, rows(feed_rejects(raw))))
