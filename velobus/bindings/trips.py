"""Feed, delay and enrichment operators bound to the given tables."""

from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query
from velobus.bindings.views import STOPS_SQL, stop_rows
from velobus.operators.asof import nearest_join
from velobus.operators.delays import delay_statistics, delay_trend
from velobus.operators.feeds import (
    attach_positions,
    keep_last,
    merge_stations,
    project_types,
    trip_summary,
    type_counts,
)


@query(
    "delay_stats",
    f"""
WITH {STOPS_SQL},
spread AS (
  SELECT *, (known * squares - total * total) / nullif(known * (known - 1), 0) AS variance
  FROM (SELECT l_orderkey AS trip, count(delay) AS known, sum(delay) AS total,
               sum(delay * delay) AS squares FROM stops GROUP BY l_orderkey))
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS stops_count, round(avg(delay), 2) AS avg_delay,
       CAST(max(delay) AS INTEGER) AS max_delay, CAST(min(delay) AS INTEGER) AS min_delay,
       round(coalesce(any_value(variance), 0), 2) AS delay_variance,
       round(sqrt(coalesce(any_value(variance), 0)), 2) AS delay_std_dev,
       CAST(max(delay) - min(delay) AS INTEGER) AS delay_range,
       CAST(count(*) FILTER (delay = 0) AS INTEGER) AS on_time_stops,
       CAST(count(*) FILTER (delay < 0) AS INTEGER) AS early_stops,
       CAST(count(*) FILTER (delay > 0) AS INTEGER) AS late_stops,
       round(1 / (1 + coalesce(any_value(variance), 0)), 3) AS consistency_score,
       round(count(*) FILTER (delay = 0) / count(delay), 3) AS punctuality_ratio,
       coalesce(round(avg(delay) FILTER (delay > 0), 2), 0) AS avg_positive_delay,
       coalesce(round(avg(delay) FILTER (delay < 0), 2), 0) AS avg_negative_delay
FROM stops JOIN spread ON trip = l_orderkey GROUP BY l_orderkey
""",
)
def delay_stats(t: Tables):
    return delay_statistics(stop_rows(t), ["l_orderkey"])


@query(
    "delay_trend",
    f"""
WITH {STOPS_SQL},
steps AS (
  SELECT l_orderkey, delay - lag(delay) OVER
         (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS step
  FROM stops),
counted AS (
  SELECT l_orderkey, count(*) FILTER (step > 0) AS rises, count(*) FILTER (step < 0) AS falls
  FROM steps GROUP BY l_orderkey)
SELECT *, CASE WHEN rises > falls * 1.5 THEN 'increasing' WHEN falls > rises * 1.5
          THEN 'decreasing' ELSE 'stable' END AS delay_trend
FROM counted
""",
)
def trend(t: Tables):
    return delay_trend(stop_rows(t), ["l_orderkey"], ["l_linenumber", "l_shipdate"])


@query(
    "trip_groups",
    """
WITH latest AS (
  SELECT o_custkey AS vehicle, o_orderpriority AS line,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS gps_headsign,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders),
stops AS (
  SELECT o.o_custkey AS vehicle, l_orderkey AS trip, l_suppkey AS route, l_returnflag AS sign,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey,
                            l_suppkey, l_extendedprice) AS place,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
  WHERE o.o_custkey <> 0)
SELECT a.vehicle AS "vehicleId", a.trip AS "tripId", a.n AS stops_count,
       l.line AS "first_routeShortName", coalesce(nullif(l.gps_headsign, ''), a.sign) AS first_headsign,
       a.route AS "first_routeId", a.l_partkey AS first_stop_id, a.delay AS "first_delayInSeconds",
       z.l_partkey AS last_stop_id, z.delay AS "last_delayInSeconds"
FROM stops a JOIN stops z ON a.trip = z.trip AND z.place = z.n
LEFT JOIN latest l ON l.vehicle = a.vehicle AND l.rn = 1
WHERE a.place = 1
""",
)
def trip_groups(t: Tables):
    positions = t.orders.select(
        F.col("o_custkey").alias("vehicleId"),
        F.col("o_orderpriority").alias("routeShortName"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("headsign"),
        F.struct("o_orderdate", "o_orderkey").alias("seen"),
    )
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    items = t.lineitem
    departures = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("vehicleId"),
        F.col("l_orderkey").alias("tripId"),
        F.col("l_suppkey").alias("routeId"),
        F.col("l_partkey").alias("stop_id"),
        F.col("l_returnflag").alias("headsign"),
        F.date_diff("l_shipdate", "o_orderdate").alias("delayInSeconds"),
        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias(
            "ord"
        ),
    )
    # The position belongs to the vehicle, so it joins the grouped trips: far fewer rows.
    valid = departures.where("vehicleId <> 0 AND tripId IS NOT NULL")
    trips = trip_summary(
        valid,
        ["vehicleId", "tripId"],
        F.col("ord"),
        ["headsign", "routeId", "stop_id", "delayInSeconds"],
        ["stop_id", "delayInSeconds"],
    ).withColumnRenamed("first_headsign", "headsign")
    located = attach_positions(trips, positions, F.col("seen"))
    return located.select(
        "vehicleId",
        "tripId",
        "stops_count",
        F.col("routeShortName").alias("first_routeShortName"),
        F.col("headsign").alias("first_headsign"),
        "first_routeId",
        "first_stop_id",
        "first_delayInSeconds",
        "last_stop_id",
        "last_delayInSeconds",
    )


@query(
    "station_merge",
    """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders),
merged AS (
  SELECT c_custkey AS station_id, c_mktsegment || ' ' || c_name AS name,
         CAST(coalesce(c_nationkey, 0) AS INTEGER) AS capacity,
         coalesce(CAST(o_orderkey % 9 AS INTEGER), 0) AS bikes_available,
         coalesce(CAST(o_orderkey % 17 AS INTEGER), 0) AS docks_available
  FROM customer LEFT JOIN ranked ON o_custkey = c_custkey AND rn = 1)
SELECT * FROM merged WHERE starts_with(name, 'BUILDING')
""",
)
def station_merge(t: Tables):
    info = t.customer.select(
        F.col("c_custkey").alias("station_id"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"),
        F.col("c_nationkey").alias("capacity"),
    )
    key = F.col("o_orderkey")
    status = t.orders.select(
        F.col("o_custkey").alias("station_id"),
        (key % 9).cast("int").alias("num_bikes_available"),
        (key % 17).cast("int").alias("num_docks_available"),
        F.array(
            F.struct(
                F.col("o_orderstatus").alias("vehicle_type_id"),
                (key % 9).cast("int").alias("count"),
            )
        ).alias("vehicle_types_available"),
        F.struct("o_orderdate", "o_orderkey").alias("seen"),
    )
    merged = merge_stations(info, status, F.col("seen"), "BUILDING", F.lit(0))
    return merged.select("station_id", "name", "capacity", "bikes_available", "docks_available")


@query(
    "type_map",
    """
SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS bike_available,
       CAST(count(*) FILTER (o_orderstatus = 'O') AS INTEGER) AS ebike_available
FROM orders GROUP BY o_custkey
""",
)
def type_map(t: Tables):
    # Three statuses exist, so a customer's list of (type, count) has at most three entries.
    kinds = (
        F.when(F.col("o_orderstatus") == "F", "bike")
        .when(F.col("o_orderstatus") == "O", "ebike")
        .otherwise("")
    )
    counted = t.orders.groupBy("o_custkey", kinds.alias("vehicle_type_id")).agg(
        F.count(F.lit(1)).cast("int").alias("count")
    )
    listed = counted.groupBy("o_custkey").agg(
        F.collect_list(F.struct("vehicle_type_id", "count")).alias("types")
    )
    return project_types(
        listed.select("o_custkey", type_counts(F.col("types")).alias("vehicle_types_available"))
    )


@query(
    "keep_last",
    """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""",
)
def last_event(t: Tables):
    events = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return keep_last(events, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query(
    "nearest_reading",
    """
WITH facts AS (SELECT event_id, ts, value FROM events WHERE event_type = 'purchase'),
readings AS (SELECT ts AS r_ts, event_id AS r_id, value AS r_value FROM events
             WHERE event_type = 'error'),
before AS (SELECT f.*, r.* FROM facts f ASOF LEFT JOIN readings r ON f.ts >= r.r_ts),
after AS (SELECT f.event_id, r.r_ts AS a_ts, r.r_id AS a_id, r.r_value AS a_value
          FROM facts f ASOF LEFT JOIN readings r ON f.ts <= r.r_ts),
both_sides AS (
  SELECT *, a_ts IS NULL OR (r_ts IS NOT NULL AND epoch_us(ts) - epoch_us(r_ts)
                             <= epoch_us(a_ts) - epoch_us(ts)) AS earlier
  FROM before JOIN after USING (event_id))
SELECT event_id, value, CASE WHEN earlier THEN r_id ELSE a_id END AS reading_id,
       CASE WHEN earlier THEN r_value ELSE a_value END AS reading_value,
       CASE WHEN earlier THEN r_ts ELSE a_ts END AS reading_ts
FROM both_sides
""",
)
def nearest_reading(t: Tables):
    facts = t.events.where("event_type = 'purchase'").select("event_id", "ts", "value")
    readings = t.events.where("event_type = 'error'").select(
        F.col("ts").alias("reading_ts"),
        F.col("event_id").alias("reading_id"),
        F.col("value").alias("reading_value"),
    )
    joined = nearest_join(
        facts,
        readings,
        "ts",
        "reading_ts",
        ["reading_id", "reading_value", "reading_ts"],
        reading_order="reading_id",
    )
    return joined.drop("ts")



