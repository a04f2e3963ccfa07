"""Canonical schemas of the transit model.

Times of day are held as an INT minute of the day, because Spark's TIME type
has no arithmetic. Money and distances are decimals, instants are zone-free.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: table layouts (Spark DDL) --------------------------------
ZONES = (
    "zone_id INT, zone_name STRING, population_density DOUBLE, "
    "avg_income DOUBLE, area_type STRING"
)
STATIONS = (
    "station_id INT, station_name STRING, zone_id INT, latitude DECIMAL(10,6), "
    "longitude DECIMAL(10,6), has_elevator BOOLEAN, has_escalator BOOLEAN, "
    "parking_available BOOLEAN, wheelchair_accessible BOOLEAN"
)
ROUTES = (
    "route_id BIGINT, route_name STRING, transport_type STRING, "
    "start_station_id INT, end_station_id INT, distance_km DECIMAL(5,2), "
    "base_fare DECIMAL(10,2), wheelchair_accessible BOOLEAN, "
    "max_capacity INT, active BOOLEAN"
)
SCHEDULES = (
    "schedule_id BIGINT, route_id BIGINT, day_of_week STRING, "
    "departure_min INT, arrival_min INT, is_peak_hour BOOLEAN"
)
FARE_CARDS = (
    "card_id BIGINT, card_number STRING, card_type STRING, issue_date DATE, "
    "last_used DATE, balance DECIMAL(10,2), total_trips INT, is_active BOOLEAN"
)
TRIPS = (
    "trip_id BIGINT, card_id BIGINT, route_id BIGINT, entry_station_id INT, "
    "exit_station_id INT, tap_in_time TIMESTAMP_NTZ, tap_out_time TIMESTAMP_NTZ, "
    "fare_paid DECIMAL(10,2), payment_method STRING, trip_date DATE, "
    "is_peak_hour BOOLEAN"
)
TRAVEL_TIME_LOGS = (
    "log_id BIGINT, route_id BIGINT, log_date DATE, log_min INT, "
    "avg_travel_time DECIMAL(5,2), scheduled_duration_minutes DECIMAL(5,2), "
    "passenger_count INT, is_peak_hour BOOLEAN, weather_condition STRING, "
    "delay_minutes INT"
)
SERVICE_AVAILABILITY = (
    "availability_id BIGINT, route_id BIGINT, check_time TIMESTAMP_NTZ, "
    "is_operational BOOLEAN, current_capacity INT, delay_minutes INT, reason STRING"
)
USERS = "user_id BIGINT, name STRING"
BOOKINGS = "booking_id BIGINT, user_id BIGINT, route_id BIGINT, ts TIMESTAMP_NTZ"
PASSENGER_LOGS = "route_id BIGINT, ts TIMESTAMP_NTZ, passenger_count INT"
TRANSPORT_ROUTES = "route_id BIGINT, route_name STRING, max_capacity INT"
STATION_FEED = (
    "station_id STRING, stop_name STRING, borough STRING, gtfs_latitude STRING, "
    "gtfs_longitude STRING, ada STRING"
)
STOP_LISTS = "line_id BIGINT, line STRING, description STRING, stops ARRAY<STRING>"

# --- derived tables: partial sums and key maps that loads maintain ------------
LOG_ROLLUP = (
    "log_date DATE, hour_of_day INT, route_id BIGINT, is_peak_hour BOOLEAN, "
    "weather_condition STRING, n BIGINT, "
    "sum_ride DECIMAL(18,2), n_ride BIGINT, sum_planned DECIMAL(18,2), n_planned BIGINT, "
    "sum_delay BIGINT, n_delay BIGINT, sum_load BIGINT, n_load BIGINT, "
    "squares DECIMAL(30,0), min_delay INT, max_delay INT, max_load INT"
)
LOAD_COUNTS = "route_id BIGINT, passenger_count INT, n BIGINT"
TRIP_ROLLUP = (
    "trip_date DATE, route_id BIGINT, hour INT, n BIGINT, "
    "sum_fare DECIMAL(20,2), n_fare BIGINT"
)
RIDER_SETS = "grain STRING, trip_date DATE, key BIGINT, bucket BIGINT, cards BIGINT"
CARD_COUNTS = "card_id BIGINT, n BIGINT, last_trip DATE"
STATION_KEYS = "feed_id STRING, station_id BIGINT"
ROUTE_KEYS = "line_id BIGINT, route_id BIGINT"

LAYOUTS = {
    "zones": ZONES,
    "stations": STATIONS,
    "routes": ROUTES,
    "schedules": SCHEDULES,
    "fare_cards": FARE_CARDS,
    "trips": TRIPS,
    "travel_time_logs": TRAVEL_TIME_LOGS,
    "service_availability": SERVICE_AVAILABILITY,
    "users": USERS,
    "bookings": BOOKINGS,
    "passenger_logs": PASSENGER_LOGS,
    "transport_routes": TRANSPORT_ROUTES,
}

#: Tables that loads keep beside the given ones.
DERIVED_LAYOUTS = {
    "log_rollup": LOG_ROLLUP,
    "load_counts": LOAD_COUNTS,
    "trip_rollup": TRIP_ROLLUP,
    "rider_sets": RIDER_SETS,
    "card_counts": CARD_COUNTS,
    "station_keys": STATION_KEYS,
    "route_keys": ROUTE_KEYS,
}

# Column a table is stored by, so that date windows prune directories.
PARTITION_COLUMNS = {"trips": "trip_date", "travel_time_logs": "log_date"}
#: Tables stored in order of an instant that look-backs and lookups bound.
TIME_COLUMNS = {
    "service_availability": "check_time",
    "bookings": "ts",
    "passenger_logs": "ts",
}

# Parents before children, for loading; the reverse clears them.
LOAD_ORDER = (
    "zones",
    "stations",
    "routes",
    "schedules",
    "fare_cards",
    "trips",
    "travel_time_logs",
    "service_availability",
)

# --- fixed values: domains ---------------------------------------------------
TRANSPORT_TYPES = ("Bus", "Metro", "Tram")
WEEKDAYS = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)
SERVICE_STATES = ("Active", "Delayed", "Out of Service", "Maintenance")
IMPORT_PEAK_HOURS = (7, 8, 17, 18)
SEED_PEAK_HOURS = (7, 8, 9, 17, 18, 19)
TRANSFER_MINUTES = 5


@dataclass(frozen=True)
class Constraints:
    """What a table promises; Spark does not enforce it, the audit reports it."""

    key: str
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    references: tuple[tuple[str, str], ...] = ()  # (column, parent table)
    lengths: dict[str, int] = field(default_factory=dict)


# --- fixed values: declared constraints --------------------------------------
CONSTRAINTS = {
    "zones": Constraints(
        "zone_id",
        required=("zone_name",),
        lengths={"zone_name": 50, "area_type": 20},
    ),
    "stations": Constraints(
        "station_id",
        required=("station_name",),
        unique=("station_name",),
        references=(("zone_id", "zones"),),
        lengths={"station_name": 100},
    ),
    "routes": Constraints(
        "route_id",
        required=("route_name", "transport_type"),
        references=(("start_station_id", "stations"), ("end_station_id", "stations")),
        lengths={"route_name": 50, "transport_type": 20},
    ),
    "schedules": Constraints(
        "schedule_id",
        references=(("route_id", "routes"),),
        lengths={"day_of_week": 10},
    ),
    "fare_cards": Constraints(
        "card_id",
        required=("card_number", "card_type", "issue_date"),
        unique=("card_number",),
        lengths={"card_number": 20, "card_type": 20},
    ),
    "trips": Constraints(
        "trip_id",
        required=("tap_in_time", "trip_date"),
        references=(
            ("card_id", "fare_cards"),
            ("route_id", "routes"),
            ("entry_station_id", "stations"),
            ("exit_station_id", "stations"),
        ),
        lengths={"payment_method": 20},
    ),
    "travel_time_logs": Constraints(
        "log_id",
        required=("log_date",),
        references=(("route_id", "routes"),),
        lengths={"weather_condition": 20},
    ),
    "service_availability": Constraints(
        "availability_id",
        references=(("route_id", "routes"),),
        lengths={"reason": 100},
    ),
}

# --- fixed values: column defaults on insert ---------------------------------
DEFAULTS = {
    "stations": {
        "has_elevator": False,
        "has_escalator": False,
        "parking_available": False,
    },
    "routes": {"wheelchair_accessible": True, "active": True},
    "schedules": {"is_peak_hour": False},
    "fare_cards": {"balance": 0, "total_trips": 0, "is_active": True},
    "trips": {"is_peak_hour": False},
    "travel_time_logs": {"is_peak_hour": False, "delay_minutes": 0},
    "service_availability": {"is_operational": True, "delay_minutes": 0},
}
