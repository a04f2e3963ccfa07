"""DuckDB SQL with the results the registered queries have to give.

``VIEWS`` derives the transit tables from the star schema; it is the SQL twin
of ``tramwise.sources.star`` and stands in front of every statement.
"""

from __future__ import annotations

from datetime import date

LOGS_AS_OF = "2000-01-31"
CHECKS_AS_OF = "2024-01-31"
# Late enough for the windows of 30 and 90 days to cut rows off.
RELIABILITY_AS_OF = "2024-02-15"
AVAILABILITY_AS_OF = "2024-04-15"
BOOKING_INSTANT = "1996-06-16 00:00:00"
JOURNEY = ("NATION_11", "NATION_2")
RIDERS_SINCE, RIDERS_UNTIL = date(1995, 3, 10), date(1996, 8, 20)

VIEWS = {
    "zones": """
        select r_regionkey zone_id, r_name zone_name,
               cast(1000 + r_regionkey * 500 as double) population_density,
               cast(40000 + r_regionkey * 5000 as double) avg_income
        from region""",
    "stations": """
        select n_nationkey station_id, n_name station_name, n_regionkey zone_id,
               cast(40 + n_nationkey * 0.01 as decimal(10,6)) latitude,
               cast(-74 + n_nationkey * 0.01 as decimal(10,6)) longitude,
               n_nationkey % 2 = 0 has_elevator,
               n_nationkey % 3 <> 0 wheelchair_accessible
        from nation""",
    "routes": """
        select s_suppkey route_id, s_name route_name,
               case s_suppkey % 3 when 0 then 'Bus' when 1 then 'Metro' else 'Tram' end
                   transport_type,
               s_nationkey start_station_id,
               cast((s_nationkey + s_suppkey % 24 + 1) % 25 as int) end_station_id,
               cast(3 + (s_suppkey % 20) * 0.65 as decimal(5,2)) distance_km,
               cast(2 + (s_suppkey % 5) * 0.25 as decimal(10,2)) base_fare,
               s_suppkey % 4 <> 0 wheelchair_accessible,
               case s_suppkey % 3 when 0 then 60 when 1 then 200 else 120 end max_capacity
        from supplier""",
    "schedules": """
        select s_suppkey route_id, d.day_no, d.day_of_week, t.departure_min,
               t.departure_min + t.ride arrival_min, t.is_peak_hour
        from supplier
        cross join (values (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'),
                           (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'),
                           (7, 'Sunday')) d(day_no, day_of_week)
        cross join (values (420, 25, true), (430, 25, true), (540, 20, false),
                           (1030, 30, true), (1260, 20, false))
                   t(departure_min, ride, is_peak_hour)""",
    "fare_cards": """
        select c_custkey card_id,
               'CARD_' || case when c_custkey < 1000000
                               then lpad(cast(c_custkey as varchar), 6, '0')
                               else cast(c_custkey as varchar) end card_number,
               case when c_custkey % 100 < 65 then 'Regular'
                    when c_custkey % 100 < 85 then 'Student'
                    when c_custkey % 100 < 95 then 'Senior'
                    else 'Accessibility' end card_type,
               c_custkey % 20 <> 0 is_active
        from customer""",
    "trips": """
        select o_orderkey trip_id, o_custkey card_id,
               o_orderkey % (select count(*) from supplier) route_id,
               o_orderdate + interval '1' hour * (o_orderkey % 24) tap_in_time,
               o_orderdate + interval '1' hour * (o_orderkey % 24)
                   + interval '1' minute * (15 + o_orderkey % 31) tap_out_time,
               cast(o_totalprice / 100000 as decimal(10,2)) fare_paid,
               cast(o_orderdate as date) trip_date
        from orders""",
    "logs": """
        select l_orderkey * 8 + l_linenumber log_id, l_suppkey route_id,
               cast(l_shipdate as date) log_date,
               cast((l_partkey % 24) * 60 + l_linenumber as int) log_min,
               cast(l_partkey % 24 as int) log_hour,
               cast(l_quantity as decimal(5,2)) ride,
               cast(20 + l_linenumber * 2 as decimal(5,2)) planned,
               cast(40 + (l_partkey * 7) % 200 as int) passengers,
               cast(l_partkey % 26 - 3 as int) delay,
               (l_partkey % 24) in (7, 8, 17, 18) peak,
               case when l_linenumber = 7 then null when l_returnflag = 'A' then 'Clear'
                    when l_returnflag = 'N' then 'Rain' else 'Fog' end weather
        from lineitem""",
    "checks": """
        select event_id availability_id,
               user_id % (select count(*) from supplier) route_id,
               ts check_time, event_type <> 'error' ok,
               cast(floor(value / 10) as int) delay,
               case event_type
                   when 'error' then case when event_id % 2 = 0
                       then 'Scheduled Maintenance' else 'Power Outage' end
                   when 'view' then null
                   when 'click' then 'Heavy Traffic'
                   else 'Normal Service' end reason
        from events""",
    "bookings": """
        select o_orderkey booking_id, o_custkey user_id,
               o_orderkey % (select count(*) from supplier) route_id, o_orderdate ts
        from orders""",
    "passenger_logs": """
        select l_suppkey route_id, l_shipdate ts,
               cast(40 + (l_partkey * 7) % 200 as int) passengers
        from lineitem""",
    "feed": """
        select cast(c_custkey // 3 as varchar) station_id, c_name stop_name,
               ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'ATLANTIS']
                   [cast((c_custkey // 3) % 6 as int) + 1] borough,
               '40.' || lpad(cast(c_nationkey as varchar), 2, '0') stop_lat,
               '-73.' || lpad(cast(c_nationkey as varchar), 2, '0') stop_lon,
               case when c_custkey % 7 <> 0 then cast(c_custkey % 2 as varchar) end ada
        from customer""",
    "stops": """
        select s_suppkey line_id,
               case when s_suppkey % 3 = 0 then 'M' else '' end
                   || cast(s_suppkey % 100 as varchar) line,
               i as position, 'NATION_' || cast((s_suppkey * 7 + i * 11) % 31 as varchar) stop
        from (select s_suppkey, unnest(range(0, s_suppkey % 5 + 1)) i from supplier)""",
    # Shared intermediate results.
    "named_routes": """
        select r.*, a.station_name start_station, b.station_name end_station,
               a.zone_id start_zone_id, b.zone_id end_zone_id
        from routes r
        join stations a on a.station_id = r.start_station_id
        join stations b on b.station_id = r.end_station_id""",
    "distinct_feed": """
        select * from feed
        qualify row_number() over (partition by station_id
            order by stop_name, borough, stop_lat, stop_lon, ada nulls last) = 1""",
    "latest": """
        select * from checks
        qualify row_number() over (partition by route_id
            order by check_time desc, availability_id desc) = 1""",
    "current_status": """
        select r.route_id, r.route_name, r.transport_type,
               coalesce(l.ok, true) is_operational, coalesce(l.delay, 0) delay_minutes,
               coalesce(l.reason, 'Normal Service') reason, l.check_time
        from routes r left join latest l using (route_id)""",
}


def deviation(value: str) -> str:
    """Sample standard deviation from exact sums."""
    n, x = f"count({value})", f"cast({value} as hugeint)"
    spread = f"({n} * sum({x} * {x}) - sum({x}) * sum({x}))"
    return r2(f"sqrt(cast({spread} as double) / nullif({n} * ({n} - 1), 0))")


def r2(value: str) -> str:
    """Two digits, half away from zero on decimals."""
    return f"cast(round(cast({value} as decimal(38,10)), 2) as double)"


def r2dec(value: str) -> str:
    return f"cast(round(cast({value} as decimal(38,10)), 2) as decimal(18,2))"


def mean(value: str, condition: str | None = None) -> str:
    where = f" filter (where {condition})" if condition else ""
    return r2(f"avg({value}){where}")


def n_if(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def exact_mean(value: str) -> str:
    return f"cast(sum({value}) as double) / nullif(count({value}), 0)"


def state(reason: str, ok: str, delay: str) -> str:
    return (
        f"case when contains({reason}, 'Maintenance') then 'Maintenance' "
        f"when {ok} and {delay} > 0 then 'Delayed' when {ok} then 'Active' "
        "else 'Out of Service' end"
    )


DOW = "cast(extract(dow from {}) as int)"
NAMED = (
    "route_id, route_name, transport_type, start_station, end_station, "
    "cast(distance_km as double) distance_km, cast(base_fare as double) base_fare"
)
CLOCK = (
    "lpad(cast({0} // 60 % 24 as varchar), 2, '0') || ':' || "
    "lpad(cast({0} % 60 as varchar), 2, '0') || ':00'"
)

ALL_ROUTES = f"""
    select {NAMED}, max_capacity, wheelchair_accessible, avg_travel_time_min, avg_delay_min
    from named_routes left join (
        select route_id, {mean('ride')} avg_travel_time_min, {mean('delay')} avg_delay_min
        from logs group by route_id) using (route_id)"""

RELIABILITY = f"""
    select route_id, route_name, transport_type, count(*) total_checks,
           {n_if('ok')} active_count,
           {n_if('not ok and delay > 0')} delayed_count,
           {n_if('not ok and delay = 0')} cancelled_count,
           {r2(f"{n_if('ok')} * 100 / cast(count(*) as double)")} reliability_percent,
           {mean('delay', 'not ok and delay > 0')} avg_delay_when_delayed
    from checks join routes using (route_id)
    where check_time >= timestamp '{RELIABILITY_AS_OF}' - interval 30 day
    group by all"""

CONNECTIONS = """
    from stations s join zones z using (zone_id)
    left join (select start_station_id station_id, count(*) n from routes group by 1) o
        using (station_id)
    left join (select end_station_id station_id, count(*) n from routes group by 1) i
        using (station_id)"""


def _timetable(rules: list[tuple[int, int, int, str, bool]], per_day: int) -> str:
    """Union of one series per rule: first, last, step, ride, peak."""
    parts, offset = [], 0
    for first, last, step, ride, peak in rules:
        parts.append(
            f"select route_id * {per_day * 7} + d.day_no * {per_day} + {offset} "
            f"+ (m - {first}) // {step} schedule_id, route_id, d.day_of_week, "
            f"cast(m as int) departure_min, cast((m + {ride}) % 1440 as int) arrival_min, "
            f"{str(peak).lower()} is_peak_hour "
            f"from routes cross join days d "
            f"cross join (select unnest(range({first}, {last} + 1, {step})) m)"
        )
        offset += (last - first) // step + 1
    days = "days as (select distinct day_no - 1 as day_no, day_of_week from schedules)"
    return f"with {days} " + " union all ".join(parts)


def _overloaded(exact: bool) -> str:
    passengers = "p" if exact else "p * greatest(coalesce(b, 0), 1)"
    bookings = "coalesce(b, 0)" if exact else "n * coalesce(b, 0)"
    return f"""
    select route_name, ts as "timestamp", cast(sum(total) as bigint) total_passengers,
           max_capacity, cast(max_capacity - sum(total) as bigint) available_seats
    from (select route_id, ts, {passengers} + {bookings} total
          from (select route_id, ts, sum(passengers) p, count(*) n
                from passenger_logs group by all)
          left join (select route_id, ts, count(*) b from bookings group by all)
              using (route_id, ts))
    join routes using (route_id)
    group by route_name, ts, max_capacity
    having sum(total) > max_capacity"""


def _seats(exact: bool) -> str:
    at = f"where ts = timestamp '{BOOKING_INSTANT}'"
    if exact:
        return f"""
    select route_name, cast(max_capacity
             - coalesce((select sum(passengers) from passenger_logs p {at}
                         and p.route_id = r.route_id), 0)
             - (select count(*) from bookings b {at} and b.route_id = r.route_id) as bigint)
             seats_available
    from routes r"""
    return f"""
    select route_name, cast(max_capacity - coalesce(sum(passengers), 0)
             - count(booking_id) as bigint) seats_available
    from routes
    left join (from passenger_logs {at}) using (route_id)
    left join (from bookings {at}) using (route_id)
    group by route_name, max_capacity"""


def _schedules(limit: int) -> str:
    return f"""
    select route_id, day_of_week as day, {CLOCK.format('departure_min')} departure_time,
           {CLOCK.format('arrival_min')} arrival_time, is_peak_hour,
           arrival_min - departure_min duration_min
    from schedules
    qualify row_number() over (partition by route_id order by day_no, departure_min)
            <= {limit}"""


def _audit() -> str:
    def nulls(table: str, column: str, source: str | None = None) -> str:
        return (
            f"select 'null:{column}' as rule, '{table}' table_name, count(*) n "
            f"from {source or table} where {column} is null"
        )

    def lengths(table: str, column: str, longest: int, source: str | None = None) -> str:
        return (
            f"select 'length:{column}', '{table}', count(*) from {source or table} "
            f"where length({column}) > {longest}"
        )

    def repeats(table: str, column: str, source: str | None = None) -> str:
        return (
            f"select 'duplicate:{column}', '{table}', "
            f"count({column}) - count(distinct {column}) from {source or table}"
        )

    def orphans(table: str, column: str, parent: str, key: str, source=None) -> str:
        return (
            f"select 'orphan:{column}->{parent}', '{table}', count(*) "
            f"from {source or table} where {column} is not null "
            f"and {column} not in (select {key} from {parent})"
        )

    long, service = "travel_time_logs", "service_availability"
    return " union all ".join(
        [
            nulls("zones", "zone_id"),
            nulls("zones", "zone_name"),
            lengths("zones", "zone_name", 50),
            "select 'length:area_type', 'zones', 0",
            repeats("zones", "zone_id"),
            nulls("stations", "station_id"),
            nulls("stations", "station_name"),
            lengths("stations", "station_name", 100),
            repeats("stations", "station_id"),
            repeats("stations", "station_name"),
            orphans("stations", "zone_id", "zones", "zone_id"),
            nulls("routes", "route_id"),
            nulls("routes", "route_name"),
            nulls("routes", "transport_type"),
            lengths("routes", "route_name", 50),
            lengths("routes", "transport_type", 20),
            repeats("routes", "route_id"),
            orphans("routes", "start_station_id", "stations", "station_id"),
            orphans("routes", "end_station_id", "stations", "station_id"),
            lengths("schedules", "day_of_week", 10),
            orphans("schedules", "route_id", "routes", "route_id"),
            nulls("fare_cards", "card_id"),
            nulls("fare_cards", "card_number"),
            nulls("fare_cards", "card_type"),
            lengths("fare_cards", "card_number", 20),
            lengths("fare_cards", "card_type", 20),
            repeats("fare_cards", "card_id"),
            repeats("fare_cards", "card_number"),
            nulls("trips", "trip_id"),
            nulls("trips", "tap_in_time"),
            nulls("trips", "trip_date"),
            "select 'length:payment_method', 'trips', 0",
            "select 'tap_out_before_tap_in', 'trips', count(*) from trips "
            "where tap_out_time < tap_in_time",
            repeats("trips", "trip_id"),
            orphans("trips", "card_id", "fare_cards", "card_id"),
            orphans("trips", "route_id", "routes", "route_id"),
            nulls(long, "log_id", "logs"),
            nulls(long, "log_date", "logs"),
            f"select 'length:weather_condition', '{long}', count(*) from logs "
            "where length(weather) > 20",
            repeats(long, "log_id", "logs"),
            orphans(long, "route_id", "routes", "route_id", "logs"),
            nulls(service, "availability_id", "checks"),
            lengths(service, "reason", 100, "checks"),
            repeats(service, "availability_id", "checks"),
            orphans(service, "route_id", "routes", "route_id", "checks"),
        ]
    )


STATEMENTS = {
    # --- routes ---------------------------------------------------------
    "all_routes": ALL_ROUTES,
    "all_routes_accessible": f"{ALL_ROUTES} where wheelchair_accessible",
    "filter_routes": f"select * from ({ALL_ROUTES}) where transport_type in "
    "('Bus', 'Metro') and avg_travel_time_min <= 25.5",
    "route_by_stations": f"""
    select {NAMED}, wheelchair_accessible, {r2('ride')} avg_travel_time_min,
           {r2('delay')} avg_delay_min,
           coalesce(a, 0) * greatest(coalesce(n, 0), 1) active_services,
           coalesce(d, 0) * greatest(coalesce(n, 0), 1) delayed_services,
           coalesce(a, 0) active_checks, coalesce(d, 0) delayed_checks
    from named_routes
    left join (select route_id, avg(ride) ride, avg(delay) delay, count(*) n
               from logs group by 1) using (route_id)
    left join (select route_id, {n_if('ok')} a, {n_if('not ok')} d from checks
               where check_time >= timestamp '{CHECKS_AS_OF}' - interval 7 day
               group by 1) using (route_id)
    where ride <= 26""",
    "alternative_routes": f"""
    with legs as (
        select * from named_routes left join (
            select route_id, {r2dec('avg(ride)')} ride, {r2dec('avg(delay)')} late
            from logs group by 1) using (route_id))
    select x.route_name route1_name, x.transport_type transport1_type, x.start_station,
           x.end_station transfer_station, cast(x.distance_km as double) distance1_km,
           cast(x.base_fare as double) fare1, y.route_name route2_name,
           y.transport_type transport2_type, y.end_station,
           cast(y.distance_km as double) distance2_km, cast(y.base_fare as double) fare2,
           cast(x.distance_km + y.distance_km as double) total_distance_km,
           cast(x.base_fare + y.base_fare as double) total_fare,
           cast(x.ride + y.ride + 5 as double) total_travel_time_min,
           cast(x.late + y.late as double) total_delay_min,
           x.wheelchair_accessible and y.wheelchair_accessible wheelchair_accessible
    from legs x join legs y on x.end_station_id = y.start_station_id
    where x.route_id <> y.route_id and x.start_station = '{JOURNEY[0]}'
      and y.end_station = '{JOURNEY[1]}'""",
    "reachable_stations": "select distinct start_station, end_station station_name "
    "from named_routes",
    "route_schedules": _schedules(10),
    "schedule_preview": _schedules(20),
    "route_lookup": "select min(route_id) route_id, route_name from named_routes "
    "group by route_name",
    "delay_traffic_light": f"""
    select route_id, avg_delay_min, case when avg_delay_min < 5 then 'green'
           when avg_delay_min < 10 then 'yellow' else 'red' end light
    from ({ALL_ROUTES})""",
    # --- performance ----------------------------------------------------
    "route_stats": f"""
    select r.route_id, any_value(route_name) route_name,
           any_value(transport_type) transport_type,
           cast(any_value(distance_km) as double) distance_km, max_capacity,
           count(distinct log_date) days_tracked, {mean('ride')} avg_duration_min,
           {mean('delay')} avg_delay_min, {mean('delay', 'peak')} peak_delay_min,
           {mean('delay', 'not peak')} offpeak_delay_min, max(delay) max_delay_min,
           {mean('passengers')} avg_passengers,
           {r2('avg(passengers) / nullif(max_capacity, 0) * 100')} utilization_percent
    from routes r left join logs l using (route_id)
    group by r.route_id, max_capacity""",
    "travel_time_trends": f"""
    select route_id, log_date, {mean('ride')} avg_duration, {mean('delay')} avg_delay,
           {mean('passengers')} avg_passengers, count(*) trip_count
    from logs where log_date >= date '{LOGS_AS_OF}' - 30
    group by route_id, log_date""",
    "peak_vs_offpeak": f"""
    select route_name, transport_type, {mean('ride', 'peak')} peak_duration,
           {mean('ride', 'not peak')} offpeak_duration, {mean('delay', 'peak')} peak_delay,
           {mean('delay', 'not peak')} offpeak_delay,
           {mean('passengers', 'peak')} peak_passengers,
           {mean('passengers', 'not peak')} offpeak_passengers
    from logs join routes using (route_id) group by route_name, transport_type""",
    "weather_impact": f"""
    select weather weather_condition, count(*) trip_count, {mean('ride')} avg_duration,
           {mean('delay')} avg_delay, max(delay) max_delay
    from logs group by weather""",
    "weather_share": """
    select weather weather_condition, count(*) trip_count,
           count(*) / cast((select count(*) from logs) as double) as share
    from logs group by weather""",
    "route_performance_export": f"""
    with moved as (
        select route_id, check_time - interval 8766 day as at, ok, delay, reason from checks)
    select log_id, log_date, log_min log_time, {DOW.format('log_date')} day_of_week,
           log_hour hour_of_day, l.route_id, route_name, transport_type, start_station,
           end_station, start_zone_id, a.zone_name start_zone, end_zone_id,
           b.zone_name end_zone, cast(distance_km as double) distance_km,
           cast(base_fare as double) base_fare, max_capacity, wheelchair_accessible,
           cast(planned as double) scheduled_duration_minutes,
           cast(ride as double) avg_travel_time, l.delay delay_minutes,
           passengers passenger_count,
           {r2('passengers / cast(max_capacity as double) * 100')}
               capacity_utilization_percent,
           weather weather_condition, peak is_peak_hour,
           case when l.delay <= 0 then 'On Time' when l.delay <= 5 then 'Slight Delay'
                when l.delay <= 15 then 'Moderate Delay' else 'Severe Delay' end
               delay_category,
           m.ok service_status, m.delay service_delay_minutes,
           m.reason service_issue_reason
    from logs l join named_routes n using (route_id)
    join zones a on a.zone_id = start_zone_id join zones b on b.zone_id = end_zone_id
    left join moved m on m.route_id = l.route_id and cast(m.at as date) = l.log_date
        and extract(hour from m.at) = l.log_hour""",
    "route_summary": f"""
    with measured as (
        select route_id, count(distinct log_date) n_days, {mean('ride')} ride,
               {mean('planned')} planned, {mean('delay')} delay,
               {deviation('delay')} spread, max(delay) worst, min(delay) best,
               avg(passengers) load, max(passengers) fullest,
               {n_if('passengers * 10 >= max_capacity * 9')} crowded,
               {n_if('peak')} peak, {n_if('not peak')} offpeak
        from logs join routes using (route_id) group by route_id)
    select route_id, route_name, transport_type, start_station, end_station,
           a.zone_name start_zone, b.zone_name end_zone,
           cast(distance_km as double) distance_km, cast(base_fare as double) base_fare,
           max_capacity, wheelchair_accessible, coalesce(n_days, 0) days_with_data,
           ride avg_duration_min, planned scheduled_duration_min, delay avg_delay_min,
           spread delay_std_dev, worst max_delay_min, best min_delay_min,
           {r2('load')} avg_passengers,
           {r2('load / nullif(max_capacity, 0) * 100')} avg_utilization_percent,
           fullest max_passengers, coalesce(crowded, 0) near_capacity_trips,
           coalesce(peak, 0) peak_hour_trips, coalesce(offpeak, 0) offpeak_trips
    from named_routes join zones a on a.zone_id = start_zone_id
    join zones b on b.zone_id = end_zone_id
    left join measured using (route_id)""",
    "daily_metrics": f"""
    select log_date, {DOW.format('log_date')} day_of_week,
           cast(year(log_date) as int) as year, cast(month(log_date) as int) as month,
           cast(day(log_date) as int) as day, route_id, route_name, transport_type,
           count(*) total_trips, {n_if('peak')} peak_trips, {mean('ride')} avg_duration,
           {mean('delay')} avg_delay, {mean('delay', 'peak')} peak_delay,
           {mean('delay', 'not peak')} offpeak_delay, {mean('passengers')} avg_passengers,
           max(passengers) max_passengers, cast(sum(passengers) as bigint) total_passengers,
           max(weather) predominant_weather
    from logs join routes using (route_id)
    group by log_date, route_id, route_name, transport_type""",
    "hourly_patterns": f"""
    select log_hour hour_of_day, route_id, route_name, transport_type, peak is_peak_hour,
           count(*) trip_count, {mean('ride')} avg_duration, {mean('delay')} avg_delay,
           {mean('passengers')} avg_passengers,
           {r2('avg(passengers) / nullif(max_capacity, 0) * 100')} avg_utilization
    from logs join routes using (route_id)
    group by log_hour, route_id, route_name, transport_type, max_capacity, peak""",
    "weather_by_route": f"""
    select route_id, route_name, transport_type, weather weather_condition,
           count(*) trip_count, {mean('ride')} avg_duration, {mean('delay')} avg_delay,
           {deviation('delay')} delay_std_dev, max(delay) max_delay,
           {mean('passengers')} avg_passengers
    from logs join routes using (route_id) where weather is not null
    group by route_id, route_name, transport_type, weather""",
    # --- service --------------------------------------------------------
    "current_service_status": "select * from current_status",
    "service_status_categories": "select *, "
    f"{state('reason', 'is_operational', 'delay_minutes')} status from current_status",
    "status_summary": f"""
    select status, count(route_id) n
    from (values ('Active'), ('Delayed'), ('Out of Service'), ('Maintenance')) s(status)
    left join (select route_id, {state('reason', 'is_operational', 'delay_minutes')} status
               from current_status) using (status)
    group by status""",
    "status_board": f"""
    select route_name as "Route", transport_type as "Type",
           {state('reason', 'is_operational', 'delay_minutes')} as "Status",
           delay_minutes as "Delay (min)", reason as "Reason"
    from current_status""",
    "service_reliability": RELIABILITY,
    "reliability_ranking": RELIABILITY,
    "availability_summary": f"""
    select cast(check_time as date) check_date,
           {DOW.format('cast(check_time as date)')} day_of_week,
           cast(hour(check_time) as int) as hour, route_id, route_name, transport_type,
           {state('reason', 'ok', 'delay')} status, delay delay_minutes, reason,
           count(*) status_count
    from checks join routes using (route_id)
    where cast(check_time as date) >= date '{AVAILABILITY_AS_OF}' - 90
    group by all""",
    # --- stations -------------------------------------------------------
    "all_stations": "select distinct station_name from stations",
    "station_details": "select station_id, station_name, zone_name, "
    "wheelchair_accessible, has_elevator, coalesce(o.n, 0) outgoing_routes, "
    f"coalesce(i.n, 0) incoming_routes {CONNECTIONS}",
    "station_connectivity": "select station_id, station_name, zone_name, "
    "population_density, avg_income, cast(latitude as double) latitude, "
    "cast(longitude as double) longitude, wheelchair_accessible, has_elevator, "
    "coalesce(o.n, 0) outgoing_routes, coalesce(i.n, 0) incoming_routes, "
    f"coalesce(o.n, 0) + coalesce(i.n, 0) total_connections {CONNECTIONS}",
    # --- capacity -------------------------------------------------------
    "seats_available": _seats(exact=False),
    "seats_available_exact": _seats(exact=True),
    "booking_list": """
    select booking_id, c_name as name, route_name, ts as "timestamp"
    from bookings join customer on c_custkey = user_id join routes using (route_id)""",
    "booking_status": f"""
    select route_id, route_name,
           case when max_capacity - count(*) > 0 then 'Seat available! Proceed to book.'
                else 'Sorry, no seats left.' end booking_status
    from bookings join routes using (route_id)
    where ts = timestamp '{BOOKING_INSTANT}'
    group by route_id, route_name, max_capacity""",
    "overloaded_services": _overloaded(exact=False),
    "overloaded_services_exact": _overloaded(exact=True),
    # --- ridership ------------------------------------------------------
    "daily_ridership": f"""
    select trip_date, count(*) total_trips, count(distinct card_id) unique_riders,
           cast(sum(fare_paid) as double) total_revenue, {exact_mean('fare_paid')} avg_fare
    from trips group by trip_date""",
    "route_performance": f"""
    select route_id, route_name, transport_type, count(trip_id) total_trips,
           cast(sum(fare_paid) as double) total_revenue, {exact_mean('fare_paid')} avg_fare,
           count(distinct card_id) unique_riders
    from routes left join trips using (route_id)
    group by route_id, route_name, transport_type""",
    "card_type_usage": """
    select card_type, count(distinct c.card_id) total_cards, count(trip_id) total_trips,
           cast(sum(fare_paid) as double) total_revenue
    from fare_cards c left join trips t on t.card_id = c.card_id group by card_type""",
    "peak_hour_analysis": f"""
    select cast(hour(tap_in_time) as int) as hour, count(*) trip_count,
           {exact_mean('fare_paid')} avg_fare, count(distinct card_id) unique_riders
    from trips group by 1""",
    "card_statistics": """
    select c.card_id, cast(count(trip_id) as int) total_trips, max(trip_date) last_used
    from fare_cards c left join trips t on t.card_id = c.card_id group by c.card_id""",
    "fare_card_numbers": "select card_id, card_number, card_type from fare_cards",
    "peak_flag": "select trip_id, tap_in_time, "
    "hour(tap_in_time) in (7, 8, 17, 18) is_peak_hour from trips",
    "peak_flag_seed": "select trip_id, tap_in_time, "
    "hour(tap_in_time) in (7, 8, 9, 17, 18, 19) is_peak_hour from trips",
    "weekend_flag": "select trip_date, isodow(trip_date) >= 6 is_weekend, "
    "count(*) total_trips from trips group by trip_date",
    "calendar": "select cast(unnest(generate_series(min(trip_date), max(trip_date), "
    "interval 1 day)) as date) as day from trips",
    # --- overview -------------------------------------------------------
    "system_kpis": f"""
    select cast(sum(max_capacity) as bigint) total_capacity,
           {exact_mean('cast(avg_travel_time_min as decimal(18,2))')} avg_travel_time,
           cast(sum(cast(distance_km as decimal(18,2))) as double) total_distance_km
    from ({ALL_ROUTES})""",
    "routes_by_type": f"select transport_type, count(*) n from ({ALL_ROUTES}) "
    "where transport_type is not null group by 1",
    "fare_histogram": """
    with cents as (select cast(base_fare * 100 as bigint) c from named_routes),
         span as (select min(c) lowest, max(c) - min(c) width from cents)
    select cast(b.bin as int) bin, (lowest * 20 + b.bin * width) / cast(2000 as double) lo,
           (lowest * 20 + (b.bin + 1) * width) / cast(2000 as double) hi, count(c) n
    from span cross join range(20) b(bin)
    left join cents on least(coalesce((c - lowest) * 20 // nullif(width, 0), 0), 19) = b.bin
    where width > 0 or (width = 0 and b.bin = 0)
    group by b.bin, lowest, width""",
    "volume_summary": " union all ".join(
        f"select '{name}' as table_name, count(*) n from {view}"
        for name, view in {
            "zones": "zones",
            "stations": "stations",
            "routes": "routes",
            "schedules": "schedules",
            "fare_cards": "fare_cards",
            "trips": "trips",
            "travel_time_logs": "logs",
            "service_availability": "checks",
            "users": "customer",
            "bookings": "bookings",
            "passenger_logs": "passenger_logs",
            "transport_routes": "routes",
            "active_cards": "fare_cards where is_active",
        }.items()
    ),
    # --- ingest ---------------------------------------------------------
    "station_feed_ingest": "select * from feed",
    "dedup_by_key": "select * from distinct_feed",
    "stratified_sample": """
    with drawn as (select *, md5('42:' || station_id) draw from distinct_feed)
    select * exclude (draw)
    from (from drawn qualify row_number() over (partition by borough order by draw) <= 12)
    where borough is not null""",
    "lookup_zone": "select f.*, zone_id from distinct_feed f "
    "left join zones on zone_name = borough",
    "surrogate_keys": "select *, row_number() over (order by substr(md5(station_id), 1, 3), "
    "station_id) number from distinct_feed",
    "stable_keys": """
    with known as (
        select station_id, row_number() over (order by substr(md5(station_id), 1, 3), station_id) number
        from (select distinct station_id from feed where ada = '1')
    )
    from known
    union all
    select station_id, (select coalesce(max(number), 0) from known)
        + row_number() over (order by substr(md5(station_id), 1, 3), station_id)
    from (select distinct station_id from feed) where station_id not in (select station_id from known)""",
    "import_stations": """
    select cast(row_number() over (order by substr(md5(f.station_id), 1, 3), f.station_id)
               as int) station_id,
           stop_name station_name, zone_id, cast(stop_lat as double) latitude,
           cast(stop_lon as double) longitude, coalesce(ada, '0') = '1' has_elevator,
           coalesce(ada, '0') = '1' wheelchair_accessible
    from distinct_feed f left join zones on zone_name = borough""",
    "routes_from_stop_lists": """
    select line_id, line route_name,
           case when length(line) <= 2 then 'Metro' else 'Bus' end transport_type,
           arg_min(station_id, position) start_station_id,
           arg_max(station_id, position) end_station_id,
           cast(2.75 as double) base_fare, true wheelchair_accessible, true active
    from stops join stations on station_name = stop
    group by line_id, line having count(*) >= 2""",
    "timetable_importer": _timetable(
        [
            (420, 530, 10, "25", True),
            (540, 1000, 20, "20", False),
            (1020, 1130, 10, "30", True),
            (1140, 1360, 20, "20", False),
        ],
        per_day=60,
    ),
    "timetable_seed": _timetable(
        [
            (360, 585, 15, "25 + route_id % 10", True),
            (600, 990, 30, "28 + route_id % 10", False),
            (1020, 1245, 15, "27 + route_id % 10", True),
        ],
        per_day=46,
    ),
    "integrity_audit": _audit(),
}

# Reports from stored sums give what those from the facts give.
STATEMENTS |= {
    f"rolled_{name}": STATEMENTS[name]
    for name in (
        "route_summary",
        "route_stats",
        "travel_time_trends",
        "peak_vs_offpeak",
        "weather_impact",
        "daily_metrics",
        "hourly_patterns",
        "weather_by_route",
        "daily_ridership",
        "route_performance",
        "peak_hour_analysis",
        "card_statistics",
    )
}
STATEMENTS["riders_of_months"] = f"""
    with trips as (
        select * from trips where trip_date between date '{RIDERS_SINCE}' and date '{RIDERS_UNTIL}'
    )
    {STATEMENTS["route_performance"]}"""


def oracle_sql() -> dict[str, str]:
    views = ",\n".join(f"{name} as ({text})" for name, text in VIEWS.items())
    return {
        key: f"with {views}\nselect * from ({text})" for key, text in STATEMENTS.items()
    }
