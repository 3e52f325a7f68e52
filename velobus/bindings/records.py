"""Row policies, texts and counters bound to the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query
from velobus.functions.text import (
    bike_metadata,
    bike_sentence,
    bus_metadata,
    bus_sentence,
    display_time,
)
from velobus.ml import registry
from velobus.operators import records
from velobus.operators.feeds import daylight_flag, epoch_instant
from velobus.schemas import BIKE_MULTICLASS_LABELS, UNKNOWN_LABELS


@query(
    "null_policy",
    """
WITH raw AS (
  SELECT doc_id AS trip_identifier, source AS station_id,
         coalesce(nullif(source, 'src1'), 'unknown') AS name,
         coalesce(nullif(lang, 'en'), 'unknown') AS route_destination,
         coalesce(CASE WHEN n_chars > 1000 THEN NULL ELSE CAST(n_chars AS DOUBLE) END, 0) AS speed,
         quality AS fine_particles_pm2_5, toxic
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM raw WHERE fine_particles_pm2_5 IS NOT NULL AND toxic IS NOT NULL
""",
)
def null_policy(t: Tables):
    documents = t.documents.select("doc_id", "source", "lang", "n_chars")
    raw = documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("trip_id"),
        F.col("source").alias("station_id"),
        F.nullif("source", F.lit("src1")).alias("name"),
        F.nullif("lang", F.lit("en")).alias("headsign"),
        F.when(F.col("n_chars") <= 1000, F.col("n_chars").cast("double")).alias("speed"),
        F.col("quality").alias("pm2_5"),
        "toxic",
    )
    return records.split_incomplete(records.replace_nulls(records.rename_columns(raw)))[0]


@query(
    "null_quarantine",
    """
SELECT doc_id AS trip_identifier, quality AS fine_particles_pm2_5, toxic
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL
""",
)
def null_quarantine(t: Tables):
    raw = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    raw = raw.withColumnRenamed("doc_id", "trip_id").withColumnRenamed("quality", "pm2_5")
    return records.split_incomplete(records.replace_nulls(records.rename_columns(raw)))[1]


@query(
    "json_props",
    """
SELECT event_id, ts, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'environment' AS type
FROM events
""",
)
def json_props(t: Tables):
    message = F.from_json("props", "k INT, type STRING")
    return t.events.select("event_id", "ts", message.alias("m")).select(
        "event_id", "ts", "m.k", F.coalesce("m.type", F.lit("environment")).alias("type")
    )


@query(
    "summary_text",
    """
SELECT o_orderkey,
       'Przejazd autobusu linii ' || o_orderpriority || ' (ID podróży: ' || o_orderkey
       || ') w kierunku ' || CASE WHEN o_orderstatus = 'P' THEN 'nieznany cel' ELSE o_orderstatus END || '.'
       || ' Został przypisany do klastra ' || (o_custkey % 8) || '.'
       || CASE WHEN o_orderstatus = 'O' THEN ' Przewidywany status: spóźniony.' ELSE '' END
       || ' Przewidywane opóźnienie: ' || (o_custkey % 3) || ' sekund.'
       || CASE WHEN o_custkey % 3 = 0
               THEN ' (Prognoza była ujemna i została obcięta do zera).' ELSE '' END
       || ' Aktualne warunki pogodowe: ' || o_orderpriority || ', temperatura: '
       || (o_custkey % 30) || '.0°C, wiatr: ' || (o_orderkey % 20) || '.0 km/h'
       || CASE WHEN o_orderkey % 4 > 0 THEN ', opady: ' || (o_orderkey % 4) || '.0 mm' ELSE '' END
       || '.'
       || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' Jakość powietrza: PM2.5 na poziomie '
          || (o_custkey % 50) || '.0 µg/m³, PM10 na poziomie ' || (o_orderkey % 90) || '.0 µg/m³.' END
       AS summary_sentence,
       strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown
FROM orders
""",
)
def summary_text(t: Tables):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    record = t.orders.select(
        "o_orderkey",
        "o_orderdate",
        F.col("o_orderpriority").alias("bus_line_number"),
        order.cast("string").alias("trip_identifier"),
        F.nullif(status, F.lit("P")).alias("route_destination"),
        (customer % 8).alias("cluster_id"),
        F.when(status == "O", "spóźniony").alias("is_late_label"),
        (customer % 3).cast("double").alias("average_delay_seconds_prediction"),
        F.lit(True).alias("average_delay_seconds_prediction_success"),
        (customer % 3 - 1).cast("double").alias("average_delay_seconds_prediction_original"),
        F.col("o_orderpriority").alias("weather_condition"),
        (customer % 30).cast("double").alias("temperature"),
        (order % 20).cast("double").alias("wind_kph"),
        (order % 4).cast("double").alias("precip_mm"),
        F.when(status != "F", (customer % 50).cast("double")).alias("fine_particles_pm2_5"),
        (order % 90).cast("double").alias("coarse_particles_pm10"),
    )
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return record.select(
        "o_orderkey",
        bus_sentence(record).alias("summary_sentence"),
        display_time(seconds).alias("shown"),
    )


@query(
    "bike_summary_text",
    """
SELECT p_partkey,
       'Stacja rowerowa ''' || p_name || ''' (ID: ' || p_partkey || ')'
       || CASE WHEN p_size > 10 THEN ' o pojemności ' || p_size || ' miejsc.' ELSE '.' END
       || CASE WHEN p_type = 'PROMO' THEN ' Wolnych doków: ' || (p_partkey % 9) || '.'
               ELSE ' Aktualnie dostępnych jest ' || (p_partkey % 7) || ' rowerów (w tym '
                    || (p_partkey % 5) || ' manualnych i 0 elektrycznych) oraz '
                    || (p_partkey % 9) || ' wolnych doków.' END
       || ' Kategoria dostępności rowerów: ' || lower(p_type) || '.'
       || ' Przewidywana liczba dostępnych rowerów w przyszłości: ' || (p_partkey % 4) || '.'
       AS summary_sentence
FROM part
""",
)
def bike_summary_text(t: Tables):
    key = F.col("p_partkey")
    record = t.part.select(
        "p_partkey",
        F.col("p_name").alias("name"),
        key.cast("string").alias("station_id"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("capacity"),
        F.when(F.col("p_type") != "PROMO", key % 7).alias("bikes_available"),
        (key % 9).alias("docks_available"),
        (key % 5).alias("manual_bikes_available"),
        F.lower("p_type").alias("bike_multiclass_label"),
        (key % 4).cast("double").alias("bike_regression_prediction"),
    )
    return record.select("p_partkey", bike_sentence(record).alias("summary_sentence"))


@query(
    "metadata_na",
    """
SELECT o_orderkey,
       'Autobus Linii ' || o_orderpriority || ' (' || o_custkey || ') - Cel: '
       || CASE WHEN o_orderstatus = 'P' THEN 'Brak Celu' ELSE o_orderstatus END || ' - '
       || strftime(o_orderdate, '%Y-%m-%d %H:%M') AS title,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE o_orderstatus END AS route_destination,
       CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS humidity,
       '[' || (o_orderkey % 5) || ',' || (o_custkey % 5) || ']' AS is_late_probabilities,
       'N/A' AS cluster_id, 55 AS fields
FROM orders
""",
)
def metadata_na(t: Tables):
    key = F.col("o_orderkey")
    record = t.orders.select(
        "o_orderkey",
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.col("o_orderpriority").alias("bus_line_number"),
        F.col("o_custkey").cast("string").alias("vehicle_id"),
        F.nullif("o_orderstatus", F.lit("P")).alias("route_destination"),
        F.when(key % 3 != 0, key % 20).alias("humidity"),
        F.array(key % 5, F.col("o_custkey") % 5).alias("is_late_probabilities"),
    )
    wanted = ["title", "route_destination", "humidity", "is_late_probabilities", "cluster_id"]
    return record.select("o_orderkey", bus_metadata(record).alias("m")).select(
        "o_orderkey",
        *[F.col("m")[c].alias(c) for c in wanted],
        F.size("m").alias("fields"),
    )


@query(
    "bike_metadata",
    """
SELECT event_id,
       'Dane dla stacji: ' || CASE WHEN event_type = 'error' THEN 'Brak nazwy' ELSE event_type END
       || ' (ID: ' || user_id || ') - ' || strftime(ts, '%Y-%m-%d %H:%M') AS title,
       CASE WHEN event_type = 'error' THEN 'N/A' ELSE event_type END AS station_name,
       strftime(ts, '%Y-%m-%d %H:%M') AS shown, 38 AS fields
FROM events
""",
)
def bike_metadata_texts(t: Tables):
    record = t.events.select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.nullif("event_type", F.lit("error")).alias("name"),
        F.col("user_id").cast("string").alias("station_id"),
    )
    return record.select("event_id", bike_metadata(record).alias("m")).select(
        "event_id",
        F.col("m.title").alias("title"),
        F.col("m.station_name").alias("station_name"),
        F.col("m.timestamp").alias("shown"),
        F.size("m").alias("fields"),
    )


@query(
    "label_map",
    """
SELECT p_partkey, CASE p_size // 10 WHEN 0 THEN 'brak' WHEN 1 THEN 'mała dostępność'
       WHEN 2 THEN 'standardowa dostępność' WHEN 3 THEN 'wysoka dostępność'
       ELSE 'nieznana_kategoria_rower' END AS label
FROM part
""",
)
def label_map(t: Tables):
    prediction = F.floor(F.col("p_size") / 10)
    label = records.label_of(prediction, BIKE_MULTICLASS_LABELS, UNKNOWN_LABELS["bike_multiclass"])
    return t.part.select("p_partkey", label.alias("label"))


@query(
    "clip_pred",
    """
WITH scored AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal - 5000 END AS x
                FROM customer)
SELECT c_custkey, x AS original, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS prediction,
       x IS NOT NULL AS success
FROM scored
""",
)
def clip_pred(t: Tables):
    x = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") - 5000)
    return t.customer.select(
        "c_custkey",
        x.alias("original"),
        records.clipped(x).alias("prediction"),
        records.succeeded(x).alias("success"),
    )


@query(
    "scalar_policies",
    """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'yes' ELSE 'no' END AS is_day,
       make_timestamp((1704067200 + CAST(json_extract(props, '$.k') AS BIGINT)) * 1000000) AS seen,
       CAST(CAST(value AS DECIMAL(8, 1)) AS DOUBLE) AS typed
FROM events
""",
)
def scalar_policies(t: Tables):
    k = F.from_json("props", "k BIGINT")["k"]
    flag = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 0)
    return t.events.select(
        "event_id",
        daylight_flag(flag).alias("is_day"),
        epoch_instant(F.lit(1704067200) + k).cast("timestamp_ntz").alias("seen"),
        F.col("value").cast("decimal(8,1)").cast("double").alias("typed"),
    )


@query(
    "registry_latest",
    """
SELECT model_name, version, quality_metric FROM (
  SELECT 'model-' || o_custkey AS model_name, o_totalprice AS quality_metric,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back
  FROM orders) WHERE back = 1
""",
)
def registry_latest(t: Tables):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    versions = t.orders.select(
        F.format_string("model-%s", F.col("o_custkey").cast("string")).alias("model_name"),
        F.row_number().over(order).alias("version"),
        F.col("o_totalprice").alias("quality_metric"),
        F.lit(None).cast("string").alias("path"),
        F.lit(False).alias("is_new_model_available"),
        F.timestamp_seconds(F.lit(0)).alias("last_updated"),
    )
    return registry.current(versions).select("model_name", F.col("version").cast("bigint").alias("version"), "quality_metric")


@query(
    "run_counters",
    """
SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS kept,
       count(*) FILTER (value <= 50) AS dropped
FROM events GROUP BY event_type
""",
)
def run_counters(t: Tables):
    flags = {"kept": F.col("value") > 50, "dropped": F.col("value") <= 50}
    return records.counters(t.events, flags, ["event_type"])
