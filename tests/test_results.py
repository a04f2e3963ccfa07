"""Results kept for a while; facts stored in buckets."""

import re
from datetime import date

import pytest
from conftest import check, log, rows

from tramwise import Transit
from tramwise.operators import performance
from tramwise.plans.bucketed import bucketed_export, store_bucketed
from tramwise.plans.refresh import current, refresh
from tramwise.plans.results import Results


@pytest.fixture
def loaded(make, network):
    days = [date(2000, 1, d) for d in (3, 4)]
    return network.with_(
        **make(
            travel_time_logs=[log(r, log_id=10 * r + d.day, day=d, delay=r) for r in (1, 2) for d in days],
            service_availability=[check(1, 1), check(2, 1, "2000-01-03 08:20:00"), check(3, 2, "2000-01-04 09:00:00")],
        ).present()
    )


def test_results_are_kept_for_their_life(spark, loaded, tmp_path):
    base, now = str(tmp_path), [0.0]
    refresh(loaded, base, "1")
    kept = Results(spark, base, life=300, clock=lambda: now[0])
    direct = rows(Transit(current(spark, base)).route_stats())
    first = kept.get("route_stats")
    assert rows(first) == direct
    again = kept.get("route_stats")
    assert again.inputFiles() == first.inputFiles()
    assert all("/_results/" in f for f in again.inputFiles())  # no table is read
    assert rows(kept.get("route_stats", route_id=2)) == [r for r in direct if r["route_id"] == 2]
    now[0] = 299.0
    assert kept.get("route_stats").inputFiles() == first.inputFiles()
    now[0] = 300.0
    assert kept.get("route_stats").inputFiles() != first.inputFiles()
    assert rows(first) == direct  # its readers may go on for a while
    now[0] = 700.0
    kept.get("route_stats")
    assert sorted((tmp_path / "_results").iterdir())
    kept.forget()
    assert list((tmp_path / "_results").iterdir()) == []


def test_a_load_is_seen_at_once(spark, loaded, tmp_path):
    base = str(tmp_path)
    refresh(loaded, base, "1")
    kept = Results(spark, base, clock=lambda: 0.0)
    assert len(kept.records("all_routes")) == 3
    refresh(type(loaded)(routes=loaded.routes.limit(1)), base, "2")
    assert len(kept.records("all_routes")) == 1


def test_results_keep_the_order(spark, loaded, tmp_path):
    base = str(tmp_path)
    refresh(loaded, base, "1")
    kept = Results(spark, base)
    for name in ("daily_metrics", "station_connectivity", "weather_by_route"):
        assert kept.records(name) == rows(getattr(Transit(current(spark, base)), name)())


def test_bucketed_facts_are_joined_in_place(spark, loaded, tmp_path):
    spark.sql("create database if not exists buckets")
    store_bucketed(loaded, "buckets", 4)
    found = bucketed_export(spark, loaded, "buckets")
    expected = performance.route_performance_export(loaded)
    assert found.columns == expected.columns
    assert sorted(map(str, rows(found))) == sorted(map(str, rows(expected)))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        t = loaded.with_(routes=loaded.routes.hint("broadcast"))
        plan = bucketed_export(spark, t, "buckets")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    lines = plan.splitlines()
    joins = [i for i, line in enumerate(lines) if "SortMergeJoin [route_id" in line and "hour_of_day" in line]
    assert len(joins) == 1
    depth = [len(re.match(r"[ :+\-]*", line).group()) for line in lines]
    below = []
    for line, own in zip(lines[joins[0] + 1 :], depth[joins[0] + 1 :]):
        if own <= depth[joins[0]]:
            break
        below.append(line)
    assert sum("FileScan" in line for line in below) == 2
    assert not [line for line in below if "Exchange" in line]
