"""The physical plans stay the ones that scale."""

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def plan_of(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.transit_queries()))
def test_no_python_and_no_pairing(name, spark):
    plan = plan_of(spark, name)
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("travel_time_trends", "GreaterThanOrEqual(l_shipdate,2000-01-01"),
        ("service_reliability", "GreaterThanOrEqual(ts,2024-01-16"),
        ("availability_summary", "GreaterThanOrEqual(ts,2024-01-16"),
        ("route_by_stations", "GreaterThanOrEqual(ts,2024-01-24"),
        ("seats_available", "EqualTo(l_shipdate,1996-06-16"),
        ("alternative_routes", "EqualTo(n_name,NATION_11)"),
    ],
)
def test_bounds_reach_the_scan(name, pushed, spark):
    assert pushed in plan_of(spark, name)


def test_columns_are_pruned(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "weather_impact"))
    assert len(read) == 1
    columns = {c.split(":")[0] for c in read[0].split(",")}
    assert columns == {"l_partkey", "l_linenumber", "l_quantity", "l_returnflag"}


@pytest.mark.parametrize("name", ["route_schedules", "dedup_by_key", "stratified_sample"])
def test_groups_are_cut_before_the_shuffle(name, spark):
    assert "WindowGroupLimit" in plan_of(spark, name)


@pytest.mark.parametrize(
    "name", ["route_summary", "hourly_patterns", "all_routes", "route_stats"]
)
def test_logs_are_aggregated_before_any_join(name, spark):
    """Every path from a scan of the logs meets an aggregate before a join."""
    frame = entry.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+\-]*", line).group()) for line in plan]
    scans = [i for i, line in enumerate(plan) if "l_suppkey" in line and "FileScan" in line]
    assert scans
    for scan in scans:
        at = depth[scan]
        for i in range(scan - 1, -1, -1):
            if depth[i] < at:
                at = depth[i]
                assert "Join" not in plan[i]
                if "Aggregate" in plan[i]:
                    break


def test_audit_reads_each_table_twice_at_most(spark):
    """Once for its rules, once more where others refer to it; one shuffle of cells."""
    frame = entry.queries()["integrity_audit"](spark, SF_DIR)
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    scans = {}
    for table in re.findall(r"sf0\.001/(\w+)\.parquet", plan):
        scans[table] = scans.get(table, 0) + 1
    # Tables of the star schema that serve one transit table each, or several.
    assert scans["lineitem"] == 1 and scans["orders"] == 1
    assert scans["customer"] <= 2 and scans["events"] <= 2
    assert plan.count("Join") - plan.count("BroadcastNestedLoopJoin") <= 6


@pytest.mark.parametrize("name", sorted(n for n in entry.transit_queries() if n.startswith(("rolled_", "riders_"))))
def test_rolled_reports_scan_no_facts(name, spark):
    plan = plan_of(spark, name)
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_the_wide_export_is_not_sorted(spark):
    assert "rangepartitioning" not in plan_of(spark, "route_performance_export")
