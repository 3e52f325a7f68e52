"""Streaming jobs over the given tables: each runs to the end of its input and is read back."""

from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query
from velobus.functions.text import bus_sentence
from velobus.operators.asof import nearest_join
from velobus.operators.feeds import flatten_environment
from velobus.session import work_dir
from velobus.sinks import tables
from velobus.sources import topics
from velobus.streaming.jobs import rolling_counts


def event_stream(t: Tables):
    """The events file as a stream."""
    schema = t.events.schema
    return (
        t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )


@query(
    "stream_equals_batch",
    """
WITH facts AS (SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k
               FROM events WHERE event_type <> 'error'),
readings AS (SELECT ts AS r_ts, value FROM events WHERE event_type = 'error'),
before AS (SELECT f.*, r.* FROM facts f ASOF LEFT JOIN readings r ON f.ts >= r.r_ts),
after AS (SELECT f.event_id, r.r_ts AS a_ts, r.value AS a_value
          FROM facts f ASOF LEFT JOIN readings r ON f.ts <= r.r_ts)
SELECT event_id, 'unknown' AS name, k,
       CASE WHEN a_ts IS NULL OR (r_ts IS NOT NULL AND epoch_us(ts) - epoch_us(r_ts)
                 <= epoch_us(a_ts) - epoch_us(ts)) THEN value ELSE a_value END AS temperature
FROM before JOIN after USING (event_id)
""",
)
def stream_equals_batch(t: Tables):
    """Events through the stream: parse, attach the nearest reading, fill nulls, store per batch."""
    from velobus.operators.records import replace_nulls, split_incomplete

    readings = t.events.where("event_type = 'error'").select("ts", F.col("value").alias("temperature"))
    root = work_dir(t.spark, "stream")

    def store(batch, batch_id):
        parsed = batch.where("event_type <> 'error'").select(
            "event_id",
            "ts",
            F.lit(None).cast("string").alias("name"),
            F.from_json("props", "k INT")["k"].alias("k"),
        )
        joined = nearest_join(parsed, readings, "ts", "ts", ["temperature"])
        complete, _ = split_incomplete(replace_nulls(joined))
        tables.write_batch(complete, f"{root}/rows", batch_id)

    run = (
        event_stream(t)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").select("event_id", "name", "k", "temperature")


@query(
    "stream_windows",
    """
SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '2024-01-01') AS window_start, count(*) AS total,
       count(*) FILTER (event_type = 'error') AS failed
FROM events
GROUP BY 1
HAVING time_bucket(INTERVAL 2 HOURS, min(ts), TIMESTAMP '2024-01-01') + INTERVAL 2 HOURS
       <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTES
""",
)
def stream_windows(t: Tables):
    """Two-hour counts as an append stream: windows closed by the watermark."""
    root = work_dir(t.spark, "windows")
    events = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = rolling_counts(events, "ts", {"failed": F.col("event_type") == "error"})
    run = (
        counted.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    rows = t.spark.read.schema("window_start TIMESTAMP, total BIGINT, failed BIGINT").parquet(
        f"{root}/rows"
    )
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "topic_roundtrip",
    """
SELECT CAST(user_id AS VARCHAR) AS station_id, event_type AS name, epoch_us(ts) // 1000000 AS seconds,
       CAST(json_extract(props, '$.k') AS INTEGER) AS bikes, event_id % 7 = 0 AS bad
FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 7 = 0
""",
)
def topic_roundtrip(t: Tables):
    """Events as station messages, published as JSON and parsed again; every seventh is broken."""
    messages = t.events.select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("user_id").cast("string").alias("station_id"),
        F.col("event_type").alias("name"),
        F.from_json("props", "k INT")["k"].alias("bikes_available"),
    )
    values = tables.to_values(messages)
    torn = F.get_json_object("value", "$.event_id").cast("bigint") % 7 == 0
    values = values.select(F.when(torn, F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value"))
    parsed = topics.parse(values, "bikes")
    kept = [
        F.when(~F.col("bad"), F.col(c)).alias(n)
        for c, n in (("station_id", "station_id"), ("name", "name"), ("timestamp", "seconds"),
                     ("bikes_available", "bikes"))
    ]
    return parsed.select(*kept, "bad")


@query(
    "environment_flat",
    """
SELECT 'environment' AS type, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS seen,
       'Town' AS city, value AS temperature, CAST(json_extract(props, '$.k') AS INTEGER) AS humidity,
       CASE WHEN event_type = 'view' THEN 'yes' ELSE 'no' END AS is_day, event_type AS condition,
       value / 2 AS pm2_5
FROM events
""",
)
def environment_flat(t: Tables):
    """Events as environment messages: published, parsed, flattened into table rows."""
    k = F.from_json("props", "k INT")["k"]
    messages = t.events.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.struct(F.lit("Town").alias("city")).alias("location"),
        F.struct(
            F.col("value").alias("temperature"),
            k.alias("humidity"),
            F.when(F.col("event_type") == "view", "yes").otherwise("no").alias("is_day"),
            F.col("event_type").alias("condition"),
        ).alias("weather"),
        F.struct((F.col("value") / 2).alias("pm2_5")).alias("air_quality"),
    )
    parsed, _ = topics.messages(tables.to_values(messages), "environment")
    return flatten_environment(parsed).select(
        "type", F.col("timestamp").cast("timestamp_ntz").alias("seen"), "city", "temperature",
        "humidity", "is_day", "condition", "pm2_5",
    )


@query(
    "document_feed",
    """
SELECT 'Autobus linii ' || o_orderpriority || ' w kierunku ' || o_orderstatus || '.' AS text,
       'city' AS workspace, CAST(o_orderkey AS VARCHAR) AS trip,
       'Trip ' || o_orderkey AS title
FROM orders
""",
)
def document_feed(t: Tables):
    """Orders as bus documents, written as a JSON feed and read back."""
    records = t.orders.select(
        F.col("o_orderpriority").alias("bus_line_number"),
        F.col("o_orderstatus").alias("route_destination"),
        F.col("o_orderkey").cast("string").alias("trip"),
    )
    records = records.withColumn("sentence", bus_sentence(records))
    title = F.concat(F.lit("Trip "), F.col("trip"))
    metadata = tables.with_title(F.create_map(F.lit("trip"), F.col("trip")), title)
    path = work_dir(t.spark, "documents")
    tables.write_document_batch(tables.documents(records, "sentence", metadata, "city"), path, 0)
    schema = "text STRING, workspace STRING, metadata MAP<STRING, STRING>"
    feed = t.spark.read.schema(schema).json(path)
    return feed.select(
        "text", "workspace", F.col("metadata.trip").alias("trip"),
        F.col("metadata.title").alias("title"),
    )
