"""Schemas of feeds, messages and tables, and the fixed values they share."""

from pyspark.sql import types as T

# --- feed documents ---------------------------------------------------------

STATION_INFO_DOC = (
    "data STRUCT<stations: ARRAY<STRUCT<station_id: STRING, name: STRING, capacity: INT>>>"
)
STATION_STATUS_DOC = (
    "data STRUCT<stations: ARRAY<STRUCT<station_id: STRING, num_bikes_available: INT, "
    "num_docks_available: INT, "
    "vehicle_types_available: ARRAY<STRUCT<vehicle_type_id: STRING, count: INT>>>>>"
)
VEHICLE_POSITIONS_DOC = (
    "vehicles ARRAY<STRUCT<vehicleId: BIGINT, routeShortName: STRING, headsign: STRING, "
    "lat: DOUBLE, lon: DOUBLE, speed: DOUBLE, direction: DOUBLE>>"
)
DEPARTURES_MAP = (
    "MAP<STRING, STRUCT<departures: ARRAY<STRUCT<vehicleId: BIGINT, tripId: BIGINT, "
    "routeId: BIGINT, headsign: STRING, delayInSeconds: INT, estimatedTime: STRING, "
    "theoreticalTime: STRING>>>>"
)
WEATHER_DOC = (
    "location STRUCT<lat: DOUBLE, lon: DOUBLE>, "
    "current STRUCT<temp_c: DOUBLE, feelslike_c: DOUBLE, wind_kph: DOUBLE, precip_mm: DOUBLE, "
    "vis_km: DOUBLE, uv: DOUBLE, humidity: INT, cloud: INT, is_day: INT, "
    "condition: STRUCT<text: STRING>, "
    "air_quality: STRUCT<pm2_5: DOUBLE, pm10: DOUBLE, co: DOUBLE, no2: DOUBLE, o3: DOUBLE, "
    "so2: DOUBLE>>"
)

NO_NAME = "Brak nazwy"  # fixed value: the name of a station without one

# --- topic messages ---------------------------------------------------------

BIKE_MESSAGE = (
    "timestamp BIGINT, station_id STRING, name STRING, capacity INT, bikes_available INT, "
    "docks_available INT, vehicle_types_available MAP<STRING, INT>"
)
STOP_STRUCT = (
    "STRUCT<stop_id: STRING, delay: INT, estimated_departure: STRING, scheduled_departure: STRING>"
)
BUS_MESSAGE = (
    "timestamp BIGINT, vehicle_id STRING, line STRING, headsign STRING, lat DOUBLE, lon DOUBLE, "
    "speed DOUBLE, direction DOUBLE, trip_id STRING, route_id STRING, "
    f"estimated_stops ARRAY<{STOP_STRUCT}>"
)
ENVIRONMENT_MESSAGE = (
    "type STRING, timestamp BIGINT, location STRUCT<city: STRING, lat: DOUBLE, lon: DOUBLE>, "
    "weather STRUCT<temperature: DOUBLE, feelslike: DOUBLE, humidity: INT, wind_kph: DOUBLE, "
    "precip_mm: DOUBLE, cloud: INT, visibility_km: DOUBLE, uv_index: DOUBLE, is_day: STRING, "
    "condition: STRING>, "
    "air_quality STRUCT<pm2_5: DOUBLE, pm10: DOUBLE, co: DOUBLE, no2: DOUBLE, o3: DOUBLE, "
    "so2: DOUBLE>"
)
MESSAGE_SCHEMAS = {
    "bikes": BIKE_MESSAGE,
    "buses": BUS_MESSAGE,
    "environment": ENVIRONMENT_MESSAGE,
}

# --- tables -----------------------------------------------------------------

ENVIRONMENT_TABLE = (
    "type STRING, timestamp TIMESTAMP, city STRING, lat DOUBLE, lon DOUBLE, "
    "temperature DECIMAL(5,2), feelslike DECIMAL(5,2), humidity INT, wind_kph DECIMAL(5,2), "
    "precip_mm DECIMAL(5,2), cloud INT, visibility_km DECIMAL(5,2), uv_index DECIMAL(4,2), "
    "is_day STRING, condition STRING, pm2_5 DECIMAL(6,2), pm10 DECIMAL(6,2), co DECIMAL(8,2), "
    "no2 DECIMAL(6,2), o3 DECIMAL(6,2), so2 DECIMAL(6,2)"
)
ANSWERS_TABLE = (
    "timestamp TIMESTAMP, question_key STRING, question_text STRING, ground_truth STRING, "
    "llm_response STRING, response_time_ms DOUBLE, llm_error BOOLEAN, llm_error_message STRING, "
    "bleu_score DOUBLE, rouge_score DOUBLE"
)
REGISTRY_TABLE = (
    "model_name STRING, version INT, quality_metric DOUBLE, path STRING, "
    "is_new_model_available BOOLEAN, last_updated TIMESTAMP"
)

# --- fixed values: the column names and their order are part of the contract --

ENV_COLS = [
    "temperature", "feelslike", "humidity", "wind_kph", "precip_mm", "cloud", "visibility_km",
    "uv_index", "is_day", "condition", "pm2_5", "pm10", "co", "no2", "o3", "so2",
]

RENAME_MAP = {
    "pm2_5": "fine_particles_pm2_5",
    "pm10": "coarse_particles_pm10",
    "co": "carbon_monoxide_ppb",
    "no2": "nitrogen_dioxide_ppb",
    "o3": "ozone_ppb",
    "so2": "sulfur_dioxide_ppb",
    "bike_available": "manual_bikes_available",
    "ebike_available": "electric_bikes_available",
    "is_day": "daylight",
    "condition": "weather_condition",
    "avg_delay": "average_delay_seconds",
    "max_delay": "maximum_delay_seconds",
    "min_delay": "minimum_delay_seconds",
    "delay_std_dev": "delay_standard_deviation",
    "delay_variance": "delay_variance_value",
    "delay_range": "delay_range_seconds",
    "early_stops": "stops_arrived_early_count",
    "late_stops": "stops_arrived_late_count",
    "on_time_stops": "stops_on_time_count",
    "consistency_score": "delay_consistency_score",
    "punctuality_ratio": "on_time_stop_ratio",
    "avg_positive_delay": "avg_positive_delay_seconds",
    "avg_negative_delay": "avg_negative_delay_seconds",
    "trip_id": "trip_identifier",
    "route_id": "route_identifier",
    "line": "bus_line_number",
    "headsign": "route_destination",
}

UNKNOWN_WHEN_NULL = ["vehicle_id", "bus_line_number", "route_destination", "station_id", "name"]
ZERO_WHEN_NULL = ["lat", "lon", "speed", "direction"]

WEATHER_COLS = [RENAME_MAP.get(c, c) for c in ENV_COLS]

DELAY_COLS = [
    "stops_count", "avg_delay", "max_delay", "min_delay", "delay_variance", "delay_std_dev",
    "delay_range", "on_time_stops", "early_stops", "late_stops", "delay_trend",
    "consistency_score", "punctuality_ratio", "avg_positive_delay", "avg_negative_delay",
]

IS_LATE_LABELS = {0: "na czas", 1: "spóźniony"}
DELAY_CATEGORY_LABELS = {0: "na czas", 1: "lekko spóźniony", 2: "bardzo spóźniony"}
BIKE_BINARY_LABELS = {0: "standardowo", 1: "mało"}
BIKE_MULTICLASS_LABELS = {
    0: "brak", 1: "mała dostępność", 2: "standardowa dostępność", 3: "wysoka dostępność",
}
UNKNOWN_LABELS = {
    "is_late": "nieznany_status",
    "delay_category": "nieznana_kategoria",
    "bike_binary": "nieznany_status_rower",
    "bike_multiclass": "nieznana_kategoria_rower",
}

CLUSTER_BIKE_FEATURES = [
    "bikes_available", "docks_available", "capacity", "manual_bikes_available",
    "electric_bikes_available", "temperature", "wind_kph", "precip_mm", "humidity",
    "weather_condition", "fine_particles_pm2_5", "coarse_particles_pm10",
]
CLUSTER_BUS_FEATURES = [
    "average_delay_seconds", "maximum_delay_seconds", "minimum_delay_seconds",
    "delay_standard_deviation", "delay_range_seconds", "on_time_stop_ratio",
    "delay_consistency_score", "stops_count", "temperature", "wind_kph", "precip_mm", "humidity",
    "weather_condition", "fine_particles_pm2_5", "coarse_particles_pm10",
]
CLASS_BIKE_FEATURES = [
    "capacity", "manual_bikes_available", "electric_bikes_available", "temperature", "feelslike",
    "humidity", "wind_kph", "precip_mm", "cloud", "visibility_km", "uv_index", "daylight",
    "weather_condition", "fine_particles_pm2_5", "coarse_particles_pm10", "carbon_monoxide_ppb",
    "nitrogen_dioxide_ppb", "ozone_ppb", "sulfur_dioxide_ppb",
]
CLASS_BUS_FEATURES = [
    "speed", "direction", "stops_count", "maximum_delay_seconds", "minimum_delay_seconds",
    "delay_variance_value", "delay_standard_deviation", "delay_range_seconds",
    "stops_on_time_count", "stops_arrived_early_count", "stops_arrived_late_count", "delay_trend",
    "delay_consistency_score", "on_time_stop_ratio", "avg_positive_delay_seconds",
    "avg_negative_delay_seconds", "temperature", "feelslike", "humidity", "wind_kph", "precip_mm",
    "cloud", "visibility_km", "uv_index", "daylight", "fine_particles_pm2_5",
    "coarse_particles_pm10", "carbon_monoxide_ppb", "nitrogen_dioxide_ppb", "ozone_ppb",
    "sulfur_dioxide_ppb", "cluster_id", "cluster_prediction_success",
]
BIKE_TARGET_COLS = ["bikes_available", "capacity"]
BUS_TARGET_COLS = ["average_delay_seconds"]

TRAINING_WINDOW_DAYS = {"cluster": 30, "class_bikes": 60, "class_buses": 90}

MODEL_NAMES = [
    "bikes_kmeans", "bikes_binary_classifier", "bikes_multiclass_classifier",
    "bikes_regression_predictor", "buses_kmeans", "bus_binary_classifier",
    "bus_multiclass_classifier", "bus_regression_predictor",
]

ENVIRONMENT_FACTORS = [
    "temperature", "humidity", "wind_kph", "precip_mm", "cloud", "visibility_km", "uv_index",
    "fine_particles_pm2_5", "coarse_particles_pm10", "carbon_monoxide_ppb",
    "nitrogen_dioxide_ppb", "ozone_ppb", "sulfur_dioxide_ppb",
]
BAD_WEATHER = [
    "Light Rain", "Moderate Rain", "Heavy Rain", "Snow", "Sleet", "Freezing Drizzle", "Blizzard",
    "Fog", "Mist",
]
HEAVY_RAIN = ["Heavy Rain", "Torrential Rain", "Moderate Rain", "Light Rain"]


def struct_type(ddl: str) -> T.StructType:
    """Parse a DDL column list without needing a session."""
    return T.StructType.fromDDL(ddl)
