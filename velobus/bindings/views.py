"""The given tables seen as feeds and stored tables, in Spark and in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.bindings.registry import Tables
from velobus.operators.delays import delay_statistics
from velobus.operators.records import label_of
from velobus.schemas import DELAY_CATEGORY_LABELS

WEATHER = ["Sunny", "Light Rain", "Heavy Rain", "Mist", "Cloudy"]


def stop_rows(t: Tables, carried: list[str] | None = None) -> DataFrame:
    """Line items as stops: order = trip, customer = vehicle, delay = days from order to shipping."""
    orders = t.orders.select("o_orderkey", "o_orderdate", *(carried or [])[1:])
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        *(carried or []),
        F.date_diff("l_shipdate", "o_orderdate").alias("delay"),
    )


STOPS_SQL = """
stops AS (
  SELECT l_orderkey, l_linenumber, l_shipdate,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def bikes_view(t: Tables) -> DataFrame:
    """Events as stored station records: user = station, the k in props drives the measures."""
    k = F.from_json("props", "k INT")["k"]
    weather = F.array(*[F.lit(w) for w in WEATHER])
    events = t.events.withColumn("k", k)
    k = F.col("k")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("station_id"),
        F.format_string("ST-%04d", "user_id").alias("name"),
        (k % 12).alias("bikes_available"),
        (k % 25).alias("docks_available"),
        (k % 5).alias("manual_bikes_available"),
        (k % 7).alias("electric_bikes_available"),
        F.get(weather, k % 5).alias("weather_condition"),
        (k % 11).alias("uv_index"),
        (40 + k % 60).alias("humidity"),
        (k % 37).alias("cloud"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")).alias("precip_mm"),
        (F.col("value") + k).alias("temperature"),
        F.col("value").alias("fine_particles_pm2_5"),
        F.col("value").alias("bike_regression_prediction"),
        (F.col("user_id") % 8).cast("int").alias("cluster_id"),
        (F.col("event_type") != "error").alias("cluster_prediction_success"),
        F.col("event_type").isin("view", "purchase").alias("bike_binary_prediction_success"),
        F.when(F.col("event_type") == "signup", "")
        .otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
        .alias("summary_sentence"),
    )


BIKES_SQL = """
raw_events AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
bikes AS (
  SELECT event_id, ts AS "timestamp", CAST(user_id AS VARCHAR) AS station_id,
         'ST-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS name,
         k % 12 AS bikes_available, k % 25 AS docks_available,
         k % 5 AS manual_bikes_available, k % 7 AS electric_bikes_available,
         CASE k % 5 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Light Rain' WHEN 2 THEN 'Heavy Rain'
                    WHEN 3 THEN 'Mist' ELSE 'Cloudy' END AS weather_condition,
         k % 11 AS uv_index, 40 + k % 60 AS humidity, k % 37 AS cloud,
         CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS precip_mm,
         value + k AS temperature, value AS fine_particles_pm2_5,
         value AS bike_regression_prediction, CAST(user_id % 8 AS INTEGER) AS cluster_id,
         event_type <> 'error' AS cluster_prediction_success,
         event_type IN ('view', 'purchase') AS bike_binary_prediction_success,
         CASE WHEN event_type = 'signup' THEN '' ELSE event_type || ' ' || event_id END
           AS summary_sentence
  FROM raw_events)
"""


def buses_view(t: Tables) -> DataFrame:
    """Trips with delay statistics as stored bus records, spread over January 2024."""
    # The order's own columns ride along as grouping keys: they depend on the order key, and the
    # grouping keeps the partitioning of the join, so orders are joined once.
    carried = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    trips = delay_statistics(stop_rows(t, carried), carried)
    key, n = F.col("o_orderkey"), F.col("stops_count")
    category = (
        F.when(F.col("avg_delay") <= 0, 0).when(F.col("avg_delay") <= 300, 1).otherwise(2)
    )
    weather = F.array(*[F.lit(w) for w in WEATHER])
    seconds = F.lit(1704067200) + key * 977 % 2592000
    return trips.select(
        "o_orderkey",
        F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("vehicle_id"),
        F.concat(F.lit("L"), (F.col("o_custkey") % 40).cast("string")).alias("bus_line_number"),
        F.col("avg_delay").alias("average_delay_seconds"),
        F.col("punctuality_ratio").alias("on_time_stop_ratio"),
        "stops_count",
        label_of(category, DELAY_CATEGORY_LABELS, "?").alias("delay_category_label"),
        (F.col("o_orderstatus") != "P").alias("delay_category_prediction_success"),
        (F.col("o_custkey") % 8).cast("int").alias("cluster_id"),
        (F.col("o_orderstatus") != "F").alias("cluster_prediction_success"),
        F.get(weather, (key % 5).cast("int")).alias("weather_condition"),
        (F.col("o_totalprice") / 7000).alias("fine_particles_pm2_5"),
        (F.col("o_totalprice") % 35).alias("temperature"),
        (key % 13).cast("double").alias("precip_mm"),
        (key % 37).cast("int").alias("cloud"),
        ((key * 7) % 10).cast("double").alias("visibility_km"),
        (n * 3 + key % 50).cast("int").alias("humidity"),
        F.col("avg_delay").alias("wind_kph"),
        (key % 11).cast("double").alias("uv_index"),
        (key * 3 % 80).cast("double").alias("coarse_particles_pm10"),
        (F.col("o_custkey") % 300 + 150).cast("double").alias("carbon_monoxide_ppb"),
        (key * 11 % 60).cast("double").alias("nitrogen_dioxide_ppb"),
        (n * 9 + key % 31).cast("double").alias("ozone_ppb"),
        (F.col("o_custkey") * 5 % 23).cast("double").alias("sulfur_dioxide_ppb"),
        F.concat_ws(" ", F.lit("trip"), key.cast("string")).alias("summary_sentence"),
    )


BUSES_SQL = (
    STOPS_SQL.strip()
    + """,
trips AS (
  SELECT l_orderkey, round(avg(delay), 2) AS avg_delay, count(*) AS stops_count,
         round(count(*) FILTER (delay = 0) / count(delay), 3) AS punctuality_ratio
  FROM stops GROUP BY l_orderkey),
buses AS (
  SELECT o_orderkey,
         make_timestamp((1704067200 + o_orderkey * 977 % 2592000) * 1000000) AS "timestamp",
         CAST(o_custkey AS VARCHAR) AS vehicle_id, 'L' || (o_custkey % 40) AS bus_line_number,
         avg_delay AS average_delay_seconds, punctuality_ratio AS on_time_stop_ratio,
         stops_count,
         CASE WHEN avg_delay <= 0 THEN 'na czas' WHEN avg_delay <= 300 THEN 'lekko spóźniony'
              ELSE 'bardzo spóźniony' END AS delay_category_label,
         o_orderstatus <> 'P' AS delay_category_prediction_success,
         CAST(o_custkey % 8 AS INTEGER) AS cluster_id,
         o_orderstatus <> 'F' AS cluster_prediction_success,
         CASE o_orderkey % 5 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Light Rain' WHEN 2 THEN 'Heavy Rain'
                    WHEN 3 THEN 'Mist' ELSE 'Cloudy' END AS weather_condition,
         o_totalprice / 7000 AS fine_particles_pm2_5, o_totalprice % 35 AS temperature,
         CAST(o_orderkey % 13 AS DOUBLE) AS precip_mm, CAST(o_orderkey % 37 AS INTEGER) AS cloud,
         CAST(o_orderkey * 7 % 10 AS DOUBLE) AS visibility_km,
         CAST(stops_count * 3 + o_orderkey % 50 AS INTEGER) AS humidity, avg_delay AS wind_kph,
         CAST(o_orderkey % 11 AS DOUBLE) AS uv_index,
         CAST(o_orderkey * 3 % 80 AS DOUBLE) AS coarse_particles_pm10,
         CAST(o_custkey % 300 + 150 AS DOUBLE) AS carbon_monoxide_ppb,
         CAST(o_orderkey * 11 % 60 AS DOUBLE) AS nitrogen_dioxide_ppb,
         CAST(stops_count * 9 + o_orderkey % 31 AS DOUBLE) AS ozone_ppb,
         CAST(o_custkey * 5 % 23 AS DOUBLE) AS sulfur_dioxide_ppb,
         'trip ' || o_orderkey AS summary_sentence
  FROM orders JOIN trips ON o_orderkey = l_orderkey)
"""
)
