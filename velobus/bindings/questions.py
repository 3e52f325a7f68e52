"""The analytic questions bound to the given tables; the horizon ends at the newest row."""

from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query, rounded
from velobus.bindings.views import BIKES_SQL, BUSES_SQL, bikes_view, buses_view
from velobus.plans import questions as q
from velobus.plans import templates
from velobus.schemas import ENVIRONMENT_FACTORS
from velobus.sources.tables import latest_instant
from velobus.sources.tables import within as recent

# Thirty days before the newest row cover the whole month the tables span.
DAYS = 30
HOURS = 24 * DAYS


def newest(t: Tables):
    return latest_instant(t.events, "ts")


BIKES = f"""
WITH {BIKES_SQL.strip()},
recent AS (SELECT * FROM bikes
           WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL {DAYS} DAYS)
"""
BUSES = f"""
WITH {BUSES_SQL.strip()},
recent AS (SELECT * FROM buses
           WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL {DAYS} DAYS)
"""
BOTH = f"""
WITH {BIKES_SQL.strip()},
{BUSES_SQL.strip()},
recent_bikes AS (SELECT * FROM bikes
                 WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL {DAYS} DAYS),
recent_buses AS (SELECT * FROM buses
                 WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL {DAYS} DAYS)
"""


@query(
    "q1_latest_status",
    BIKES
    + f"""
SELECT name, cluster_id, cluster_prediction_success AS success, precip_mm > 0 AS rain,
       'Dla stacji rowerowej ''' || name || ''': Id klastra to ' || cluster_id
       || '. Predykcja klastra była '
       || CASE WHEN cluster_prediction_success THEN 'udana' ELSE 'nieudana' END
       || '. W tym czasie występowały silne opady deszczu: '
       || CASE WHEN precip_mm > 0 THEN 'tak' ELSE 'nie' END || '.' AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY "timestamp" DESC, event_id DESC) AS rn
      FROM recent) WHERE rn = 1
""",
)
def q1(t: Tables):
    return q.station_cluster_status(bikes_view(t), newest(t), HOURS, ["event_id"])


@query(
    "q2_cluster_mode",
    BUSES
    + f"""
, counted AS (SELECT cluster_id, delay_category_label AS label, count(*) AS n
              FROM recent GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS rn
           FROM counted),
vehicles AS (SELECT cluster_id, count(DISTINCT vehicle_id) AS vehicles FROM recent GROUP BY 1)
SELECT cluster_id, vehicles, label AS dominant,
       'W ciągu ostatnich {HOURS} godzin, ' || vehicles
       || ' unikalnych autobusów należało do klastra o id ''' || cluster_id
       || '''. Dominująca kategoria opóźnienia dla tych autobusów to: ''' || label || '''.' AS answer
FROM vehicles JOIN ranked USING (cluster_id) WHERE rn = 1
""",
)
def q2(t: Tables):
    return q.cluster_delay_category(buses_view(t), newest(t), HOURS)


@query(
    "q3_filtered_mean",
    BIKES
    + "SELECT round(avg(electric_bikes_available), 6) AS mean_electric FROM recent "
    "WHERE bike_binary_prediction_success",
)
def q3(t: Tables):
    return rounded(q.mean_electric_bikes(bikes_view(t), newest(t), HOURS).drop("answer"))


@query(
    "q4_top_label_mean",
    BUSES
    + """
SELECT delay_category_label, count(*) AS n, round(avg(on_time_stop_ratio), 6) AS mean_on_time_ratio
FROM recent WHERE delay_category_prediction_success
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1
""",
)
def q4(t: Tables):
    return rounded(q.top_delay_label(buses_view(t), newest(t), HOURS).drop("answer"))


@query(
    "q5_mode_when_low",
    BIKES
    + f"""
SELECT cluster_id, weather_condition, n,
       'Dla stacji rowerowych w klastrze o id ''' || cluster_id
       || ''', które miały niską dostępność rowerów w ciągu ostatnich {HOURS} godzin, '
       || 'najczęściej występującym warunkiem pogodowym było: ''' || weather_condition || '''.'
       AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, weather_condition) AS rn
      FROM (SELECT cluster_id, weather_condition, count(*) AS n FROM recent
            WHERE bikes_available < 5 GROUP BY ALL))
WHERE rn = 1
""",
)
def q5(t: Tables):
    return q.low_availability_weather(bikes_view(t), newest(t), HOURS)


@query(
    "q6_two_group_verdict",
    BUSES
    + """
, means AS (
  SELECT bus_line_number,
         coalesce(avg(fine_particles_pm2_5) FILTER (delay_category_prediction_success), 0) AS good,
         coalesce(avg(fine_particles_pm2_5) FILTER (NOT delay_category_prediction_success), 0) AS bad
  FROM recent GROUP BY 1)
SELECT bus_line_number, round(good, 6) AS mean_success, round(bad, 6) AS mean_failure,
       CASE WHEN good > bad AND bad <> 0 THEN 'higher' WHEN good < bad AND good <> 0 THEN 'lower'
            ELSE 'none' END AS verdict
FROM means
""",
)
def q6(t: Tables):
    return rounded(q.pm25_by_success(buses_view(t), newest(t), HOURS).drop("answer"))


@query(
    "q7_corr_bands",
    BIKES
    + """
, grouped AS (
  SELECT name, count(*) AS n, corr(humidity, bike_regression_prediction) AS ch,
         corr(temperature, bike_regression_prediction) AS ct
  FROM recent GROUP BY name HAVING count(*) >= 2)
SELECT name, n, round(ch, 6) AS corr_humidity, round(ct, 6) AS corr_temperature,
       CASE WHEN ch > 0.3 THEN 'positive' WHEN ch < -0.3 THEN 'negative'
            WHEN ch IS NOT NULL THEN 'weak' END AS humidity_impact,
       CASE WHEN ct > 0.3 THEN 'positive' WHEN ct < -0.3 THEN 'negative'
            WHEN ct IS NOT NULL THEN 'weak' END AS temperature_impact
FROM grouped
""",
)
def q7(t: Tables):
    return rounded(q.forecast_correlations(bikes_view(t), newest(t), HOURS).drop("answer"))


@query(
    "q8_mode_numeric",
    BUSES
    + """
SELECT bus_line_number, visibility_km, n
FROM (SELECT *, row_number() OVER (PARTITION BY bus_line_number ORDER BY n DESC, visibility_km) AS rn
      FROM (SELECT bus_line_number, visibility_km, count(*) AS n FROM recent
            WHERE delay_category_label = 'bardzo spóźniony' GROUP BY ALL))
WHERE rn = 1
""",
)
def q8(t: Tables):
    return q.late_visibility(buses_view(t), newest(t), HOURS).drop("answer")


@query(
    "q9_pair_mean",
    BOTH
    + """
, sunny AS (SELECT *, CAST("timestamp" AS DATE) AS day FROM recent_bikes WHERE uv_index > 7),
pairs AS (
  SELECT s.cluster_id, avg(b.average_delay_seconds) AS mean_delay
  FROM sunny s JOIN recent_buses b
    ON s.day = CAST(b."timestamp" AS DATE) AND s.weather_condition = b.weather_condition
  GROUP BY 1),
sides AS (SELECT cluster_id, avg(manual_bikes_available) AS m, avg(electric_bikes_available) AS e
          FROM sunny GROUP BY 1)
SELECT cluster_id, round(m, 6) AS mean_manual, round(e, 6) AS mean_electric,
       CASE WHEN m > e THEN 'manual' ELSE 'electric' END AS more, round(mean_delay, 6) AS mean_delay
FROM sides LEFT JOIN pairs USING (cluster_id)
""",
)
def q9(t: Tables):
    result = q.high_uv_bikes_and_delay(bikes_view(t), buses_view(t), newest(t), DAYS)
    return rounded(result.drop("answer"))


@query(
    "q10_best_hour",
    BOTH
    + """
, a AS (SELECT date_trunc('hour', "timestamp") AS hour, avg(bikes_available) AS mean_bikes,
               avg(cloud) AS c1 FROM recent_bikes GROUP BY 1),
b AS (SELECT date_trunc('hour', "timestamp") AS hour, avg(average_delay_seconds) AS mean_delay,
             avg(cloud) AS c2 FROM recent_buses GROUP BY 1),
clear AS (SELECT * FROM a JOIN b USING (hour) WHERE c1 < 20 AND c2 < 20),
limits AS (SELECT min(mean_bikes) AS lb, max(mean_bikes) AS hb, min(mean_delay) AS ld,
                  max(mean_delay) AS hd FROM clear)
SELECT hour, round(mean_bikes, 6) AS mean_bikes, round(mean_delay, 6) AS mean_delay,
       round(CASE WHEN hb > lb THEN (mean_bikes - lb) / (hb - lb) ELSE 0 END
             + CASE WHEN hd > ld THEN (hd - mean_delay) / (hd - ld) ELSE 0 END, 6) AS score
FROM clear, limits ORDER BY score DESC, hour LIMIT 1
""",
)
def q10(t: Tables):
    return rounded(q.best_hour(bikes_view(t), buses_view(t), newest(t), DAYS).drop("answer"))


@query(
    "q11_top_factors",
    BUSES
    + ", flags AS (SELECT *, CAST(delay_category_prediction_success AS INTEGER) AS ok FROM recent),\n"
    + "long AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS factor, {i} AS place, corr(ok, {f}) AS c FROM flags"
        for i, f in enumerate(ENVIRONMENT_FACTORS)
    )
    + """)
SELECT factor, round(c, 6) AS correlation,
       CASE WHEN c > 0 THEN 'pozytywny' ELSE 'negatywny' END AS impact
FROM long WHERE c IS NOT NULL ORDER BY abs(c) DESC, place LIMIT 3
""",
)
def q11(t: Tables):
    return rounded(q.top_factors(buses_view(t), newest(t), DAYS))


@query(
    "q12_sector_rates",
    BOTH
    + """
, a AS (SELECT 100.0 * count(*) FILTER (cluster_prediction_success) / count(*) AS rate,
               avg(temperature) FILTER (cluster_prediction_success) AS temp FROM recent_bikes),
b AS (SELECT 100.0 * count(*) FILTER (cluster_prediction_success) / count(*) AS rate,
             avg(temperature) FILTER (cluster_prediction_success) AS temp FROM recent_buses)
SELECT round(a.rate, 6) AS bike_rate, round(a.temp, 6) AS bike_temp, round(b.rate, 6) AS bus_rate,
       round(b.temp, 6) AS bus_temp,
       CASE WHEN a.rate > b.rate THEN 'bike' WHEN b.rate > a.rate THEN 'bus' ELSE 'equal' END
       AS winner
FROM a, b
""",
)
def q12(t: Tables):
    result = q.sector_success(bikes_view(t), buses_view(t), newest(t), DAYS)
    return rounded(result.drop("answer"))


@query(
    "q13_refill",
    BIKES
    + """
, low AS (SELECT name, count(*) AS times_low, max("timestamp") AS last_low FROM recent
          WHERE bikes_available < 5 AND weather_condition IN ('Light Rain', 'Heavy Rain', 'Mist')
          GROUP BY name ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1)
SELECT name, times_low, bikes_available, bike_regression_prediction, weather_condition
FROM recent JOIN low USING (name) ORDER BY "timestamp" DESC, event_id DESC LIMIT 1
""",
)
def q13(t: Tables):
    result = q.station_needing_refill(bikes_view(t), newest(t), HOURS, tie=["event_id"])
    return result.drop("answer")


@query(
    "q14_top3",
    BUSES
    + """
SELECT bus_line_number, count(*) AS n FROM recent
WHERE average_delay_seconds > 300 AND precip_mm > 5 AND delay_category_prediction_success
  AND weather_condition IN ('Heavy Rain', 'Torrential Rain', 'Moderate Rain', 'Light Rain')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3
""",
)
def q14(t: Tables):
    return q.rain_delay_lines(buses_view(t), newest(t), DAYS)


@query(
    "q15_spike_corr",
    BIKES
    + """
, moved AS (SELECT *, docks_available - lag(docks_available) OVER
                   (PARTITION BY station_id ORDER BY "timestamp", event_id) AS change FROM recent),
row_ AS (SELECT count(*) FILTER (change > 5) AS n, avg(fine_particles_pm2_5) FILTER (change > 5) AS m,
                corr(fine_particles_pm2_5, docks_available) AS c FROM moved)
SELECT n AS sudden_increases, round(m, 6) AS mean_pm25, round(c, 6) AS corr,
       CASE WHEN c > 0.3 THEN 'positive' WHEN c < -0.3 THEN 'negative'
            WHEN c IS NOT NULL THEN 'weak' ELSE 'unknown' END AS verdict
FROM row_
""",
)
def q15(t: Tables):
    result = q.pollution_and_docks(bikes_view(t), newest(t), DAYS, tie=["event_id"])
    return rounded(result.drop("answer"))


@query(
    "q16_latest_text",
    BOTH
    + """
SELECT 'bike' AS sector, arg_max(summary_sentence, ("timestamp", event_id)) AS summary_sentence
FROM recent_bikes WHERE summary_sentence <> ''
UNION ALL
SELECT 'bus', arg_max(summary_sentence, ("timestamp", o_orderkey))
FROM recent_buses WHERE summary_sentence <> ''
""",
)
def q16(t: Tables):
    bikes = bikes_view(t).withColumnRenamed("event_id", "row_id")
    buses = buses_view(t).withColumnRenamed("o_orderkey", "row_id")
    return q.latest_sentences({"bike": bikes, "bus": buses}, newest(t), DAYS, tie=["row_id"])


def _template_rows() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    return ",\n".join(f"({quoted(k)}, {quoted(p)}, {quoted(x)})" for k, p, _, x in templates.TEMPLATES)


def _sampled(column: str, table: str) -> str:
    return (
        f"(SELECT * FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS value FROM {table}) "
        "ORDER BY md5('0' || value), value LIMIT 20)"
    )


@query(
    "q17_expand",
    BOTH
    + f"""
, templates(question_key, parameter, template) AS (VALUES {_template_rows()}),
params AS (
  SELECT 'station_name' AS parameter, value FROM {_sampled("name", "recent_bikes")}
  UNION ALL SELECT 'bus_line_number', value FROM {_sampled("bus_line_number", "recent_buses")}
  UNION ALL SELECT 'cluster_id', value FROM (
    SELECT value FROM {_sampled("cluster_id", "recent_bikes")}
    UNION SELECT value FROM {_sampled("cluster_id", "recent_buses")}))
SELECT question_key, value,
       replace(replace(replace(template, '{{' || parameter || '}}', coalesce(value, '')),
                       '{{time_interval_hours}}', '2'), '{{time_interval_days}}', '7')
       AS question_text
FROM templates LEFT JOIN params USING (parameter)
WHERE parameter = '' OR value IS NOT NULL
""",
)
def q17(t: Tables):
    values = templates.parameter_values(bikes_view(t), buses_view(t), newest(t), HOURS)
    return templates.question_set(values)


@query(
    "time_scan",
    """
WITH bounds AS (SELECT max(o_orderdate) AS m FROM orders)
SELECT 'cluster' AS job, o_orderkey, o_totalprice FROM orders, bounds
WHERE o_orderdate >= m - INTERVAL 30 DAYS
UNION ALL
SELECT 'class_bikes', o_orderkey, o_totalprice FROM orders, bounds
WHERE o_orderdate >= m - INTERVAL 60 DAYS
UNION ALL
SELECT 'class_buses', o_orderkey, o_totalprice FROM orders, bounds
WHERE o_orderdate >= m - INTERVAL 90 DAYS
""",
)
def time_scan(t: Tables):
    from velobus.schemas import TRAINING_WINDOW_DAYS
    from velobus.sources.tables import training_scan

    orders, end = t.orders, latest_instant(t.orders, "o_orderdate")
    wanted = ["o_orderkey", "o_totalprice", "no_such_column"]
    parts = [
        training_scan(orders, wanted, days, end, "o_orderdate").select(F.lit(job).alias("job"), "*")
        for job, days in TRAINING_WINDOW_DAYS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "recent_rows",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS",
)
def recent_rows(t: Tables):
    return recent(t.events, newest(t), hours=48, time="ts").select("event_id", "ts")
