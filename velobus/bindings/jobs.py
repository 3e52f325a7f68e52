"""Whole jobs over the given tables: feeds, producers, scoring streams, answers, registry.

Feed documents, messages and answers are derived from the tables by Spark, handed to the job, and
what the job stores is read back."""

from pyspark.sql import functions as F

from velobus.bindings.evaluation import BLEU_SQL, ROUGE_SQL, turn_pairs
from velobus.bindings.registry import Tables, query, rounded
from velobus.evaluation.scores import answers_table, record_answers, score_cycle
from velobus.ml import registry
from velobus.operators.delays import with_delay_statistics
from velobus.operators.feeds import flatten_environment, weather_message
from velobus.plans import producers
from velobus.session import work_dir
from velobus.sinks import tables
from velobus.sources import feeds, topics
from velobus.streaming import jobs

STATIONS_PER_POLL = 100
VEHICLES_PER_POLL = 50
INGEST = 9  # seconds


def _documents(rows, poll, body, order):
    """One document per poll: its rows, in order, as the JSON value that body makes of their list."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct("*").alias("row"))))
    grouped = rows.groupBy(poll.cast("bigint").alias("poll")).agg(F.transform(listed, lambda x: x["row"]).alias("rows"))
    return grouped.select(F.to_json(body(F.col("rows"))).alias("value"), F.lit("document").alias("file"), "poll")


@query(
    "feed_stations",
    """
WITH s AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 6 <> 0 THEN
         CASE WHEN c_custkey % 2 = 0 THEN 'GDA' ELSE 'SOP' END || c_custkey END AS name
  FROM customer)
SELECT 9::BIGINT AS "timestamp", k::VARCHAR AS station_id, name,
       CASE WHEN k % 4 = 0 THEN 0 ELSE k % 30 END::INT AS capacity,
       CASE WHEN k % 5 = 0 THEN 0 ELSE k % 9 + 1 END::INT AS bikes_available,
       CASE WHEN k % 5 = 0 THEN 0 ELSE k % 7 END::INT AS docks_available,
       CASE WHEN k % 5 = 0 THEN NULL ELSE k % 3 + 1 END::INT AS bike,
       CASE WHEN k % 5 = 0 OR k % 2 = 1 THEN NULL ELSE 0 END::INT AS ebike
FROM s WHERE name LIKE 'GDA%'
""",
)
def feed_stations(t: Tables):
    """Customers as stations of two feeds: one document per poll and feed, every status twice (the
    last counts), some without status, name or capacity, some with empty or repeated type ids."""
    k = F.col("c_custkey")
    poll = F.floor(k / STATIONS_PER_POLL)
    name = F.when(k % 6 != 0, F.concat(F.when(k % 2 == 0, "GDA").otherwise("SOP"), k.cast("string")))
    station = t.customer.select(
        k, F.struct(k.cast("string").alias("station_id"), name.alias("name"), F.when(k % 4 != 0, k % 30).cast("int").alias("capacity")).alias("s")
    )

    def body(rows):
        return F.struct(F.struct(F.transform(rows, lambda r: r["s"]).alias("stations")).alias("data"))

    info = _documents(station, poll, body, ["c_custkey"])
    again = t.customer.where(k % 5 != 0).select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    kinds = [(F.lit("bike"), F.lit(7)), (F.lit(""), F.lit(1)), (F.lit("bike"), (k % 3 + F.col("turn")).cast("int"))]
    typed = F.array(*[F.struct(i.alias("vehicle_type_id"), n.cast("int").alias("count")) for i, n in kinds])
    electric = F.array(F.struct(F.lit("ebike").alias("vehicle_type_id"), F.lit(None).cast("int").alias("count")))
    state = again.select(
        k, "turn",
        F.struct(
            k.cast("string").alias("station_id"),
            (k % 9 + F.col("turn")).cast("int").alias("num_bikes_available"),
            (k % 7).cast("int").alias("num_docks_available"),
            F.when(k % 2 == 0, F.concat(typed, electric)).otherwise(typed).alias("vehicle_types_available"),
        ).alias("s"),
    )
    status = _documents(state, poll, body, ["turn", "c_custkey"])
    found = producers.stations_of(info, status, "GDA", F.lit(INGEST))
    types = F.col("vehicle_types_available")
    return found.select(
        "timestamp", "station_id", "name", "capacity", "bikes_available", "docks_available",
        F.try_element_at(types, F.lit("bike")).alias("bike"), F.try_element_at(types, F.lit("ebike")).alias("ebike"),
    )


@query(
    "missing_keys",
    """
SELECT c_custkey::VARCHAR AS station_id,
       CASE c_custkey % 3 WHEN 0 THEN 'S' || c_custkey WHEN 1 THEN 'Brak nazwy' END AS name,
       CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE 0 END::INT AS capacity, 0 AS bikes_available
FROM customer
""",
)
def missing_keys(t: Tables):
    """Customers as stations whose name and capacity are there, not there, or there and null; no
    station has a status."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit(',"name":"S'), k.cast("string"), F.lit('"'))).when(k % 3 == 1, "").otherwise(',"name":null')
    capacity = F.when(k % 4 == 0, ',"capacity":5').when(k % 4 == 2, ',"capacity":null').when(k % 4 == 3, ',"capacity":0').otherwise("")
    station = F.concat(F.lit('{"station_id":"'), k.cast("string"), F.lit('"'), name, capacity, F.lit("}"))
    polls = t.customer.groupBy(F.floor(k / STATIONS_PER_POLL).cast("bigint").alias("poll")).agg(F.array_join(F.collect_list(station), ",").alias("all"))
    info = polls.select(F.concat(F.lit('{"data":{"stations":['), "all", F.lit("]}}")).alias("value"), F.lit("document").alias("file"), "poll")
    found = producers.stations_of(info, info.limit(0), None, F.lit(INGEST), exact=True)
    return found.select("station_id", "name", "capacity", "bikes_available")


@query(
    "feed_trips",
    """
WITH stops AS (
  SELECT o_custkey AS v, o_orderkey AS trip, l_linenumber AS stop, row_number() OVER (
           PARTITION BY o_custkey, o_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS place,
         l_returnflag AS sign, l_suppkey AS route,
         CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END::INT AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 1 AND o_custkey <> 0)
SELECT 9::BIGINT AS "timestamp", v::VARCHAR AS vehicle_id, trip::VARCHAR AS trip_id,
       CASE WHEN v % 4 <> 0 THEN 'L' || v % 40 END AS line,
       CASE WHEN v % 4 <> 0 AND v % 3 <> 0 THEN 'H' || v ELSE min(sign) FILTER (place = 1) END AS headsign,
       min(route) FILTER (place = 1)::VARCHAR AS route_id, count(*)::INT AS stops,
       string_agg(stop || ':' || coalesce(delay::VARCHAR, '-'), ' ' ORDER BY place) AS delays
FROM stops GROUP BY v, trip
""",
)
def feed_trips(t: Tables):
    """Orders as trips of two feeds: positions (listed twice, some vehicles missing or without
    headsign) and departures by stop, some without vehicle; one document per poll and feed."""
    v = F.col("o_custkey")
    poll = F.floor(v / VEHICLES_PER_POLL)
    seen = t.orders.where(v % 4 != 0).select(v).distinct().withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    vehicle = F.struct(
        v.cast("bigint").alias("vehicleId"),
        F.concat(F.when(F.col("turn") == 1, "L").otherwise("old"), (v % 40).cast("string")).alias("routeShortName"),
        F.when(v % 3 == 0, "").otherwise(F.concat(F.lit("H"), v.cast("string"))).alias("headsign"),
    )
    positions = _documents(
        seen.select("o_custkey", "turn", vehicle.alias("s")), poll,
        lambda rows: F.struct(F.transform(rows, lambda r: r["s"]).alias("vehicles")), ["turn", "o_custkey"],
    )
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    items = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    departure = F.struct(
        F.when(v % 10 != 1, v).cast("bigint").alias("vehicleId"),
        F.col("o_orderkey").cast("bigint").alias("tripId"),
        F.col("l_suppkey").cast("bigint").alias("routeId"),
        F.col("l_returnflag").alias("headsign"),
        F.when(F.col("l_linenumber") % 3 != 2, F.date_diff("l_shipdate", "o_orderdate")).alias("delayInSeconds"),
    )
    order = F.struct("o_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("o")
    stops = items.select(poll.cast("bigint").alias("poll"), F.col("l_linenumber").cast("string").alias("stop"), order, departure.alias("d"))
    stops = stops.groupBy("poll", "stop").agg(F.array_sort(F.collect_list(F.struct("o", "d"))).alias("list"))
    entry = F.struct("stop", F.struct(F.transform("list", lambda x: x["d"]).alias("departures")).alias("at"))
    stops = stops.groupBy("poll").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stops"))
    departures = stops.select(F.to_json("stops").alias("value"), F.lit("document").alias("file"), "poll")
    trips = producers.trips_of(positions, departures, F.lit(INGEST))
    shown = F.transform(
        "estimated_stops",
        lambda s: F.concat(s["stop_id"], F.lit(":"), F.coalesce(s["delay"].cast("string"), F.lit("-"))),
    )
    return trips.select(
        "timestamp", "vehicle_id", "trip_id", "line", "headsign", "route_id",
        F.size("estimated_stops").alias("stops"), F.array_join(shown, " ").alias("delays"),
    )


@query(
    "feed_weather",
    """
SELECT 'environment' AS type, TIMESTAMP '1970-01-01 00:00:09' AS seen, 'Town' AS city, value AS temperature,
       k % 100 AS humidity, CASE WHEN event_type = 'view' THEN 'yes' ELSE 'no' END AS is_day,
       event_type AS condition, CASE WHEN event_id % 3 <> 0 THEN value / 4 END AS pm2_5
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""",
)
def feed_weather(t: Tables):
    """Events as weather documents, made into messages, parsed as topic values and flattened."""
    current = F.struct(
        F.col("value").alias("temp_c"),
        (F.from_json("props", "k INT")["k"] % 100).alias("humidity"),
        F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 0).alias("is_day"),
        F.struct(F.col("event_type").alias("text")).alias("condition"),
        F.struct(F.when(F.col("event_id") % 3 != 0, F.col("value") / 4).alias("pm2_5")).alias("air_quality"),
    )
    value = F.to_json(F.struct(F.struct(F.lit(1.0).alias("lat")).alias("location"), current.alias("current")))
    messages = weather_message(feeds.weather(t.events.select(value.alias("value"))), "Town", F.lit(INGEST))
    parsed, _ = topics.messages(tables.to_values(messages), "environment")
    return flatten_environment(parsed).select(
        "type", F.col("timestamp").cast("timestamp_ntz").alias("seen"), "city", "temperature", "humidity",
        "is_day", "condition", "pm2_5",
    )


@query(
    "nested_delays",
    """
WITH stops AS (
  SELECT o_orderkey AS k, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
         CASE WHEN o_orderkey % 50 <> 2 AND l_linenumber % 4 <> 0 THEN
              date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60 END AS d
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
listed AS (SELECT * FROM stops WHERE k % 50 > 1 AND l_linenumber IS NOT NULL),
known AS (
  SELECT *, d - lag(d) OVER (PARTITION BY k ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS step
  FROM listed WHERE d IS NOT NULL),
stats AS (
  SELECT k, count(*) AS n, avg(d) AS mean, max(d) AS high, min(d) AS low, coalesce((count(*) * sum(d * d) - sum(d) ** 2) / nullif(count(*) * (count(*) - 1), 0), 0) AS v,
         count(*) FILTER (d = 0) AS zero, count(*) FILTER (d < 0) AS neg, count(*) FILTER (d > 0) AS pos,
         avg(d) FILTER (d > 0) AS mean_pos, avg(d) FILTER (d < 0) AS mean_neg,
         count(*) FILTER (step > 0) AS up, count(*) FILTER (step < 0) AS down
  FROM known GROUP BY k),
sizes AS (SELECT k, count(*) AS stops FROM listed GROUP BY k)
SELECT o_orderkey AS trip_id, coalesce(stops, 0)::INT AS stops_count, coalesce(round(mean, 2), 0) AS avg_delay,
       coalesce(high, 0)::INT AS max_delay, coalesce(low, 0)::INT AS min_delay,
       round(coalesce(v, 0), 2) AS delay_variance, round(sqrt(coalesce(v, 0)), 2) AS delay_std_dev,
       coalesce(high - low, 0)::INT AS delay_range, coalesce(zero, 0)::INT AS on_time_stops,
       coalesce(neg, 0)::INT AS early_stops, coalesce(pos, 0)::INT AS late_stops,
       CASE WHEN up > down * 1.5 THEN 'increasing' WHEN down > up * 1.5 THEN 'decreasing' ELSE 'stable' END AS delay_trend,
       round(1 / (1 + coalesce(v, 0)), 3) AS consistency_score, coalesce(round(zero / n, 3), 0) AS punctuality_ratio,
       coalesce(round(mean_pos, 2), 0) AS avg_positive_delay, coalesce(round(mean_neg, 2), 0) AS avg_negative_delay
FROM orders LEFT JOIN stats ON k = o_orderkey LEFT JOIN sizes ON sizes.k = o_orderkey
""",
)
def nested_delays(t: Tables):
    """Trips with their stops as a list: some lists null, some empty, some with null delays only."""
    k = F.col("o_orderkey")
    orders = t.orders.select("o_orderkey", "o_orderdate")
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    joined = orders.join(items, k == F.col("l_orderkey"), "left")
    late = F.date_diff("l_shipdate", "o_orderdate") - 60
    delay = F.when((k % 50 != 2) & (F.col("l_linenumber") % 4 != 0), late).cast("int")
    stop = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", delay.alias("delay"))
    listed = F.array_sort(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), stop)))
    trips = joined.groupBy("o_orderkey").agg(listed.alias("all"))
    stops = F.transform("all", lambda s: F.struct(F.lit("s").alias("stop_id"), s["delay"].alias("delay")))
    empty = F.slice(stops, 1, 0)
    trips = trips.select(k.alias("trip_id"), F.when(k % 50 == 1, empty).when(k % 50 > 1, stops).alias("estimated_stops"))
    return with_delay_statistics(trips)


FACTS_SQL = """
facts AS (
  SELECT event_id, epoch_us(ts) // 1000000 AS s, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events WHERE event_type <> 'error'),
readings AS (
  SELECT epoch_us(ts) // 1000000 AS r, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS rk
  FROM events WHERE event_type = 'error' GROUP BY 1),
near AS (
  SELECT f.*, b.r AS br, b.rk AS bk, a.r AS ar, a.rk AS ak
  FROM facts f ASOF LEFT JOIN readings b ON f.s >= b.r ASOF LEFT JOIN readings a ON f.s <= a.r),
weather AS (
  SELECT event_id, s, k, CASE WHEN ar IS NULL OR (br IS NOT NULL AND s - br <= ar - s) THEN bk ELSE ak END AS w
  FROM near)
"""


def _sector_run(t: Tables) -> jobs.Paths:
    """Events through both streams: errors as weather, in two micro-batches, then all others as
    stations, in four; every 11th message is torn, every 7th lacks its capacity, every 5th its name."""
    root, k = work_dir(t.spark, "sector"), F.from_json("props", "k INT")["k"]
    events = t.events.withColumn("k", k).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    readings = events.where("event_type = 'error'").groupBy("s").agg(F.max("k").alias("k"))
    fixed = {"wind_kph": 10.0, "precip_mm": 0.0, "visibility_km": 9.0, "uv_index": 1.0}
    number = F.col("k").cast("double")
    sky = F.struct(
        number.alias("temperature"), number.alias("feelslike"), F.col("k").alias("humidity"), F.lit(50).alias("cloud"),
        F.lit("yes").alias("is_day"), F.concat(F.lit("C"), (F.col("k") % 5).cast("string")).alias("condition"),
        *[F.lit(v).alias(n) for n, v in fixed.items()],
    )
    air = F.struct(*[F.lit(1.0).alias(c) for c in ("pm2_5", "pm10", "co", "no2", "o3", "so2")])
    place = F.struct(F.lit("Town").alias("city"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    seen = readings.select(
        F.lit("environment").alias("type"), F.col("s").alias("timestamp"), place.alias("location"), sky.alias("weather"), air.alias("air_quality")
    )
    i = F.col("event_id")
    counts = F.create_map(F.lit("bike"), (F.col("k") % 3).cast("int"), F.lit("ebike"), (F.col("k") % 4).cast("int"))
    stations = events.where("event_type <> 'error'").select(
        F.col("s").alias("timestamp"), i.cast("string").alias("station_id"),
        F.when(i % 5 != 0, F.concat(F.lit("ST"), i.cast("string"))).alias("name"),
        F.when(i % 7 != 0, 10).alias("capacity"), (F.col("k") % 10).alias("bikes_available"),
        F.lit(3).alias("docks_available"), counts.alias("vehicle_types_available"),
    )
    torn = F.get_json_object("value", "$.station_id").cast("bigint") % 11 == 0
    values = tables.to_values(stations).select(F.when(torn, F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value"))
    tables.to_values(seen).repartition(2).write.text(f"{root}/weather_topic")
    values.repartition(4).write.text(f"{root}/bikes_topic")
    weather, bikes = jobs.Paths(root, "environment"), jobs.Paths(root, "bikes")
    jobs.ingest_environment(topics.file_topic(t.spark, f"{root}/weather_topic", 1), weather).awaitTermination()
    stream = topics.file_topic(t.spark, f"{root}/bikes_topic", 1)
    jobs.run_sector(jobs.BIKES, stream, weather, bikes, "city").awaitTermination()
    return bikes


@query(
    "sector_stream",
    "WITH " + FACTS_SQL.strip() + """
SELECT event_id::VARCHAR AS station_id, CASE WHEN event_id % 5 <> 0 THEN 'ST' || event_id ELSE 'unknown' END AS name,
       k % 10 AS bikes, k % 3 AS manual, k % 4 AS electric, make_timestamp(s * 1000000) AS seen,
       'C' || w % 5 AS condition, w AS humidity, w::DOUBLE AS temperature, false AS clustered, true AS told
FROM weather WHERE event_id % 7 <> 0 AND event_id % 11 <> 0
""",
)
def sector_stream(t: Tables):
    """The committed rows of the scoring stream, each with whether its sentence is in the feed."""
    paths = _sector_run(t)
    told = paths.read(t.spark, "documents").select(F.col("metadata.station_id").alias("_id"), "text")
    rows = paths.read(t.spark, "rows").join(told, F.col("station_id") == F.col("_id"), "left")
    return rows.select(
        "station_id", "name", F.col("bikes_available").alias("bikes"), F.col("manual_bikes_available").alias("manual"),
        F.col("electric_bikes_available").alias("electric"), F.col("timestamp").cast("timestamp_ntz").alias("seen"),
        F.col("weather_condition").alias("condition"), "humidity", "temperature",
        F.col("cluster_prediction_success").alias("clustered"),
        (F.col("summary_sentence") == F.col("text")).alias("told"),
    )


@query(
    "stream_log",
    "WITH " + FACTS_SQL.strip() + """
SELECT 'bikes' AS service, level, event, n FROM (
  SELECT 'INFO' AS level, 'read' AS event, count(*) AS n FROM weather
  UNION ALL SELECT 'INFO', 'stored', count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) FROM weather
  UNION ALL SELECT 'INFO', 'clustered', 0
  UNION ALL SELECT 'ERROR', 'unreadable', count(*) FILTER (event_id % 11 = 0) FROM weather
  UNION ALL SELECT 'WARNING', 'incomplete', count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 = 0) FROM weather
  UNION ALL SELECT 'WARNING', 'speechless', 0)
""",
)
def stream_log(t: Tables):
    """What the scoring stream's batches logged, summed up."""
    log = _sector_run(t).read(t.spark, "log")
    return log.groupBy("service", "level", "event").agg(F.sum("n").alias("n"))


@query(
    "publish_counts",
    """
SELECT 'customers' AS service, level, event, n, arrived FROM (
  SELECT 'INFO' AS level, 'total' AS event, count(*) AS n, NULL AS arrived FROM customer
  UNION ALL SELECT 'INFO', 'sent', count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 13 <> 0),
                   count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 13 <> 0) FROM customer
  UNION ALL SELECT 'ERROR', 'failed', count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 13 = 0),
                   count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 13 = 0) FROM customer)
""",
)
def publish_counts(t: Tables):
    """Customers as messages, some without an id and some too long: what was sent, what set aside."""
    k, root = F.col("c_custkey"), work_dir(t.spark, "publish")
    messages = t.customer.select(
        F.when(k % 7 != 0, k.cast("string")).alias("station_id"),
        F.when(k % 13 == 0, F.repeat(F.lit("x"), 500)).otherwise("short").alias("name"),
    )
    done = producers.publish(
        messages, lambda m: tables.publish_files(m, f"{root}/topic"), lambda m: tables.publish_files(m, f"{root}/aside"),
        required=["station_id"], max_bytes=400,
    )
    arrived = [("sent", t.spark.read.text(f"{root}/topic").count()), ("failed", t.spark.read.text(f"{root}/aside").count())]
    rows = t.spark.createDataFrame(done.log("customers"), "service STRING, level STRING, event STRING, n BIGINT")
    return rows.join(t.spark.createDataFrame(arrived, "event STRING, arrived BIGINT"), "event", "left")


@query(
    "answers_cycle",
    "WITH RECURSIVE " + BLEU_SQL + "," + ROUGE_SQL + """
SELECT pair AS question_key, ends_with(pair, '-2') AS llm_error,
       CASE WHEN ends_with(pair, '-2') THEN NULL ELSE round(coalesce(bleu, 0), 6) END AS bleu_score,
       CASE WHEN ends_with(pair, '-2') THEN NULL ELSE round(2.0 * n / (len(r) + len(h)), 6) END AS rouge_score
FROM words JOIN bleus USING (pair) LEFT JOIN longest USING (pair)
""",
)
def answers_cycle(t: Tables):
    """Answers recorded in two deltas, the second correcting part of the first, scored twice with a
    compaction between, and read back."""
    pairs, when = turn_pairs(t), F.lit("2024-01-01").cast("timestamp")
    asked = pairs.select(F.col("pair").alias("question_key"), F.lit(None).cast("string").alias("value"), F.lit("?").alias("question_text"), F.col("truth").alias("ground_truth"))
    given = pairs.select(
        F.col("pair").alias("question_key"), F.lit(None).cast("string").alias("value"), F.col("answer").alias("llm_response"),
        F.lit(1.0).alias("response_time_ms"), F.col("pair").endswith("-2").alias("llm_error"), F.lit(None).cast("string").alias("llm_error_message"),
    )
    answers = record_answers(asked, given, when)
    table = answers_table(t.spark, work_dir(t.spark, "answers"))
    late = F.col("question_key").endswith("-4")
    table.append(answers.withColumn("llm_response", F.when(late, "not yet").otherwise(F.col("llm_response"))).where(~late | (F.length("ground_truth") % 2 == 0)))
    table.append(answers.where(late))
    score_cycle(table)
    table.compact()
    score_cycle(table)
    return rounded(table.read().select("question_key", "llm_error", "bleu_score", "rouge_score"))


@query(
    "registry_flow",
    """
SELECT 'model-' || o_custkey AS model_name, count(*)::INT AS version,
       arg_max(o_totalprice, o_orderkey) AS quality_metric, count(*) % 2 = 1 AS waiting
FROM orders GROUP BY o_custkey
""",
)
def registry_flow(t: Tables):
    """Orders as trainings of their customers' models; models with an even number of trainings have
    had the last one promoted. The current state of every model, by the registry's own reading."""
    from pyspark.sql import Window

    times = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("model_name"),
        F.row_number().over(times).alias("version"),
        F.col("o_totalprice").cast("double").alias("quality_metric"),
        F.lit("somewhere").alias("path"),
        F.lit(True).alias("is_new_model_available"),
        F.timestamp_seconds(F.lit(0)).alias("last_updated"),
        F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"),
    )
    promoted = rows.where("version = n AND n % 2 = 0").withColumns(
        {"is_new_model_available": F.lit(False), "last_updated": F.timestamp_seconds(F.lit(1))}
    )
    current = registry.current(rows.unionByName(promoted).drop("n"))
    return current.select("model_name", "version", "quality_metric", F.col("is_new_model_available").alias("waiting"))
