"""Transit tables derived from a retail star schema stored as parquet.

Suppliers act as routes, nations as stations, line items as travel-time logs,
orders as trips and events as status checks. Everything stays lazy; date
filters on the derived columns reach the parquet scan.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

STAR_LAYOUTS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
        "c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
        "value DOUBLE, props STRING"
    ),
}

# Days between the years of the events and those of the line items.
CHECK_SHIFT_DAYS = 8766


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_LAYOUTS[name]).parquet(f"{base}/{name}.parquet")


def tables(spark: SparkSession, base: str, shift_checks: bool = False) -> Tables:
    """All tables over ``base``.

    ``shift_checks`` moves the status checks back to the years of the logs, for
    the one report that joins the two; elsewhere the raw instants are kept, so
    that look-back filters can be pushed down.
    """
    scan = partial(read, spark, base)

    def n_routes() -> Column:
        return scan("supplier").agg(F.count(F.lit(1))).scalar()

    return Tables(
        zones=lambda: _zones(scan("region")),
        stations=lambda: _stations(scan("nation")),
        routes=lambda: _routes(scan("supplier")),
        schedules=lambda: _schedules(scan("supplier")),
        fare_cards=lambda: _fare_cards(scan("customer")),
        trips=lambda: _trips(scan("orders"), n_routes()),
        travel_time_logs=lambda: _logs(scan("lineitem")),
        service_availability=lambda: _checks(scan("events"), n_routes(), shift_checks),
        users=lambda: scan("customer").selectExpr(
            "c_custkey as user_id", "c_name as name"
        ),
        bookings=lambda: _bookings(scan("orders"), n_routes()),
        passenger_logs=lambda: scan("lineitem").selectExpr(
            "l_suppkey as route_id",
            "l_shipdate as ts",
            "cast(40 + (l_partkey * 7) % 200 as int) as passenger_count",
        ),
        transport_routes=lambda: _routes(scan("supplier")).select(
            "route_id", "route_name", "max_capacity"
        ),
    )


def station_feed(spark: SparkSession, base: str) -> DataFrame:
    """A landed feed as JSON text, three raw rows per station."""
    customer = read(spark, base, "customer")
    rows = customer.selectExpr(
        "cast(c_custkey div 3 as string) as station_id",
        "c_name as stop_name",
        "element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', "
        "'ATLANTIS'), cast((c_custkey div 3) % 6 as int) + 1) as borough",
        "concat('40.', lpad(cast(c_nationkey as string), 2, '0')) as gtfs_latitude",
        "concat('-73.', lpad(cast(c_nationkey as string), 2, '0')) as gtfs_longitude",
        "case when c_custkey % 7 <> 0 then cast(c_custkey % 2 as string) end as ada",
    )
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def stop_lists(spark: SparkSession, base: str) -> DataFrame:
    """Lines with one to five stops, some of them unknown stations."""
    return read(spark, base, "supplier").selectExpr(
        "s_suppkey as line_id",
        "concat(case when s_suppkey % 3 = 0 then 'M' else '' end, "
        "cast(s_suppkey % 100 as string)) as line",
        "s_name as description",
        "transform(sequence(0, cast(s_suppkey % 5 as int)), "
        "i -> concat('NATION_', cast((s_suppkey * 7 + i * 11) % 31 as string))) "
        "as stops",
    )


def _zones(region: DataFrame) -> DataFrame:
    return region.selectExpr(
        "r_regionkey as zone_id",
        "r_name as zone_name",
        "cast(1000 + r_regionkey * 500 as double) as population_density",
        "cast(40000 + r_regionkey * 5000 as double) as avg_income",
        "if(r_regionkey % 2 = 0, 'Residential', 'Commercial') as area_type",
    )


def _stations(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "n_nationkey as station_id",
        "n_name as station_name",
        "n_regionkey as zone_id",
        "cast(40 + n_nationkey * 0.01 as decimal(10,6)) as latitude",
        "cast(-74 + n_nationkey * 0.01 as decimal(10,6)) as longitude",
        "n_nationkey % 2 = 0 as has_elevator",
        "n_nationkey % 3 <> 0 as wheelchair_accessible",
    )


def _routes(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey as route_id",
        "s_name as route_name",
        "case s_suppkey % 3 when 0 then 'Bus' when 1 then 'Metro' else 'Tram' end "
        "as transport_type",
        "s_nationkey as start_station_id",
        "cast((s_nationkey + s_suppkey % 24 + 1) % 25 as int) as end_station_id",
        "cast(3 + (s_suppkey % 20) * 0.65 as decimal(5,2)) as distance_km",
        "cast(2 + (s_suppkey % 5) * 0.25 as decimal(10,2)) as base_fare",
        "s_suppkey % 4 <> 0 as wheelchair_accessible",
        "case s_suppkey % 3 when 0 then 60 when 1 then 200 else 120 end "
        "as max_capacity",
        "true as active",
    )


def _schedules(supplier: DataFrame) -> DataFrame:
    days = supplier.selectExpr(
        "s_suppkey as route_id",
        "explode(array('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', "
        "'Saturday', 'Sunday')) as day_of_week",
    )
    runs = days.selectExpr(
        "route_id",
        "day_of_week",
        "inline(array(struct(420, 25, true), struct(430, 25, true), "
        "struct(540, 20, false), struct(1030, 30, true), struct(1260, 20, false))) "
        "as (departure_min, ride_min, is_peak_hour)",
    )
    return runs.selectExpr(
        "route_id",
        "day_of_week",
        "departure_min",
        "departure_min + ride_min as arrival_min",
        "is_peak_hour",
    )


def _fare_cards(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey as card_id",
        "concat('CARD_', lpad(cast(c_custkey as string), "
        "greatest(6, length(cast(c_custkey as string))), '0')) as card_number",
        "case when c_custkey % 100 < 65 then 'Regular' "
        "when c_custkey % 100 < 85 then 'Student' "
        "when c_custkey % 100 < 95 then 'Senior' else 'Accessibility' end as card_type",
        "cast(null as date) as last_used",
        "cast(c_acctbal as decimal(10,2)) as balance",
        "0 as total_trips",
        "c_custkey % 20 <> 0 as is_active",
    )


def _trips(orders: DataFrame, n_routes: Column) -> DataFrame:
    hour = F.col("o_orderkey") % 24
    tap_in = F.col("o_orderdate") + F.make_dt_interval(hours=hour.cast("int"))
    ride = F.make_dt_interval(mins=(15 + F.col("o_orderkey") % 31).cast("int"))
    payment = F.col("o_orderkey") % 5
    return orders.select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_custkey").alias("card_id"),
        (F.col("o_orderkey") % n_routes).alias("route_id"),
        tap_in.alias("tap_in_time"),
        (tap_in + ride).alias("tap_out_time"),
        (F.col("o_totalprice") / 100000).cast("decimal(10,2)").alias("fare_paid"),
        F.when(payment == 4, "Cash")
        .when(payment == 3, "Mobile")
        .otherwise("Card")
        .alias("payment_method"),
        F.col("o_orderdate").cast("date").alias("trip_date"),
        hour.isin(7, 8, 17, 18).alias("is_peak_hour"),
    )


def _bookings(orders: DataFrame, n_routes: Column) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("booking_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % n_routes).alias("route_id"),
        F.col("o_orderdate").alias("ts"),
    )


def _logs(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber as log_id",
        "l_suppkey as route_id",
        "cast(l_shipdate as date) as log_date",
        "cast((l_partkey % 24) * 60 + l_linenumber as int) as log_min",
        "cast(l_quantity as decimal(5,2)) as avg_travel_time",
        "cast(20 + l_linenumber * 2 as decimal(5,2)) as scheduled_duration_minutes",
        "cast(40 + (l_partkey * 7) % 200 as int) as passenger_count",
        "cast(l_partkey % 26 - 3 as int) as delay_minutes",
        "(l_partkey % 24) in (7, 8, 17, 18) as is_peak_hour",
        "case when l_linenumber = 7 then null when l_returnflag = 'A' then 'Clear' "
        "when l_returnflag = 'N' then 'Rain' else 'Fog' end as weather_condition",
    )


def _checks(events: DataFrame, n_routes: Column, shifted: bool) -> DataFrame:
    at = F.col("ts")
    if shifted:
        at = at - F.make_dt_interval(days=F.lit(CHECK_SHIFT_DAYS))
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("availability_id"),
        (F.col("user_id") % n_routes).alias("route_id"),
        at.alias("check_time"),
        (kind != "error").alias("is_operational"),
        F.floor(F.col("value") / 10).cast("int").alias("delay_minutes"),
        F.when(
            kind == "error",
            F.when(F.col("event_id") % 2 == 0, "Scheduled Maintenance").otherwise(
                "Power Outage"
            ),
        )
        .when(kind == "view", None)
        .when(kind == "click", "Heavy Traffic")
        .otherwise("Normal Service")
        .alias("reason"),
    )
