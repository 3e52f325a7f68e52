"""Questions on small hand-made tables, their answers, and the question set."""

import re

import pytest
from pyspark.sql import functions as F

from velobus.functions.statistics import correlation
from velobus.plans import questions as q
from velobus.plans import templates

AS_OF = "2024-01-02 12:00:00"
BIKE = (
    "timestamp TIMESTAMP, station_id STRING, name STRING, bikes_available INT, docks_available INT, "
    "manual_bikes_available INT, electric_bikes_available INT, temperature DOUBLE, humidity INT, "
    "precip_mm DOUBLE, cloud INT, uv_index DOUBLE, weather_condition STRING, "
    "fine_particles_pm2_5 DOUBLE, cluster_id INT, cluster_prediction_success BOOLEAN, "
    "bike_binary_prediction_success BOOLEAN, bike_regression_prediction DOUBLE, "
    "summary_sentence STRING"
)
BUS = (
    "timestamp TIMESTAMP, vehicle_id STRING, bus_line_number STRING, average_delay_seconds DOUBLE, "
    "on_time_stop_ratio DOUBLE, temperature DOUBLE, humidity INT, wind_kph DOUBLE, "
    "precip_mm DOUBLE, cloud INT, visibility_km DOUBLE, uv_index DOUBLE, weather_condition STRING, "
    "fine_particles_pm2_5 DOUBLE, coarse_particles_pm10 DOUBLE, carbon_monoxide_ppb DOUBLE, "
    "nitrogen_dioxide_ppb DOUBLE, ozone_ppb DOUBLE, sulfur_dioxide_ppb DOUBLE, cluster_id INT, "
    "cluster_prediction_success BOOLEAN, is_late_label STRING, delay_category_label STRING, "
    "delay_category_prediction_success BOOLEAN, summary_sentence STRING"
)
KINDS = {"STRING": None, "BOOLEAN": True}


def table(spark, schema, rows):
    """Rows given as dicts; columns left out get a plain value."""
    base = {"timestamp": "2024-01-02 11:00:00", "name": "A", "station_id": "a", "vehicle_id": "v",
            "bus_line_number": "L", "weather_condition": "Sunny", "summary_sentence": "s",
            "cluster_id": 1, "delay_category_label": "na czas", "is_late_label": "na czas"}
    fields = [part.split() for part in schema.split(", ")]
    data = []
    for row in rows:
        values = []
        for name, kind in fields:
            default = base.get(name, KINDS.get(kind, 1.0 if kind == "DOUBLE" else 1))
            value = row.get(name, default)
            values.append(str(value) if name == "timestamp" else value)
        data.append(tuple(values))
    text = schema.replace("timestamp TIMESTAMP", "timestamp STRING")
    frame = spark.createDataFrame(data, text)
    return frame.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def bikes(spark, *rows):
    return table(spark, BIKE, rows)


def buses(spark, *rows):
    return table(spark, BUS, rows)


def test_horizon(spark):
    frame = bikes(spark, {"timestamp": "2024-01-02 09:59:59", "name": "old"}, {"name": "new"})
    assert [r["name"] for r in q.station_cluster_status(frame, AS_OF).collect()] == ["new"]


def test_q1_answer(spark):
    frame = bikes(
        spark,
        {"timestamp": "2024-01-02 11:30:00", "cluster_id": 4, "precip_mm": None,
         "cluster_prediction_success": False},
        {"timestamp": "2024-01-02 11:00:00"},
    )
    assert q.station_cluster_status(frame, AS_OF).first()["answer"] == (
        "Dla stacji rowerowej 'A': Id klastra to 4. Predykcja klastra była nieudana. "
        "W tym czasie występowały silne opady deszczu: nie."
    )


def test_q2_without_labels(spark):
    frame = buses(spark, {"delay_category_label": None}, {"delay_category_label": ""})
    row = q.cluster_delay_category(frame, AS_OF).first()
    assert (row["vehicles"], row["dominant"]) == (1, "brak danych")


def test_q3_without_rows(spark):
    frame = bikes(spark, {"bike_binary_prediction_success": False})
    row = q.mean_electric_bikes(frame, AS_OF).first()
    assert row["mean_electric"] is None and row["answer"].startswith("Brak danych")


def test_q6_verdict(spark):
    frame = buses(
        spark,
        {"fine_particles_pm2_5": 2.0, "delay_category_prediction_success": True},
        {"fine_particles_pm2_5": 1.0, "delay_category_prediction_success": None},
        {"bus_line_number": "M", "fine_particles_pm2_5": 3.0},
    )
    rows = {r["bus_line_number"]: r for r in q.pm25_by_success(frame, AS_OF).collect()}
    assert (rows["L"]["mean_success"], rows["L"]["mean_failure"], rows["L"]["verdict"]) == (
        2.0, 1.0, "higher",
    )
    assert (rows["M"]["mean_failure"], rows["M"]["verdict"]) == (0.0, "none")
    assert rows["L"]["answer"].endswith("predykcji: 2.00. Dla niepomyślnych predykcji: 1.00.")


def test_correlation_without_variation(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x DOUBLE, y DOUBLE")
    c = correlation(F.col("x"), F.col("y"))
    assert frame.agg(c).first()[0] is None
    assert frame.limit(1).agg(c).first()[0] is None
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x DOUBLE, y DOUBLE")
    assert line.agg(c).first()[0] == pytest.approx(1.0)


def test_q9_pair_mean(spark):
    b = bikes(spark, *[{"uv_index": 8.0, "manual_bikes_available": 2}] * 2, {"uv_index": 3.0})
    v = buses(
        spark,
        {"average_delay_seconds": 10.0},
        {"average_delay_seconds": 40.0},
        {"average_delay_seconds": 99.0, "timestamp": "2024-01-01 11:00:00"},
        {"average_delay_seconds": 77.0, "weather_condition": "Rain"},
    )
    row = q.high_uv_bikes_and_delay(b, v, AS_OF).first()
    assert (row["mean_manual"], row["mean_electric"], row["more"], row["mean_delay"]) == (
        2.0, 1.0, "manual", 25.0,
    )
    assert "więcej rowerów manualnych (2.0) niż elektrycznych (1.0)" in row["answer"]
    assert row["answer"].endswith("średnie opóźnienie autobusów wynosiło 25.0 sekund.")


def test_q10_prefers_bikes_and_short_delays(spark):
    hours = [("2024-01-02 09:10:00", 5, 30.0), ("2024-01-02 10:10:00", 9, 10.0)]
    b = bikes(spark, *[{"timestamp": t, "bikes_available": n} for t, n, _ in hours])
    v = buses(spark, *[{"timestamp": t, "average_delay_seconds": d} for t, _, d in hours])
    row = q.best_hour(b, v, AS_OF).first()
    assert (row["hour"].hour, row["mean_bikes"], row["mean_delay"], row["score"]) == (10, 9, 10, 2)
    assert "to około 10:00" in row["answer"]
    assert q.best_hour(b, v, AS_OF, by="hour_of_day").first()["hour"] == 10
    assert q.best_hour(b.limit(1), v.limit(1), AS_OF).first()["score"] == 0.0
    cloudy = b.withColumn("cloud", F.lit(20))
    assert q.best_hour(cloudy, v, AS_OF).collect() == []


def test_q11_answer(spark):
    frame = buses(
        spark,
        {"delay_category_prediction_success": True, "temperature": 1.0, "humidity": 5},
        {"delay_category_prediction_success": False, "temperature": 2.0, "humidity": 4},
    )
    ranked = q.top_factors(frame, AS_OF)
    assert [(r["factor"], r["impact"]) for r in ranked.collect()] == [
        ("temperature", "negatywny"), ("humidity", "pozytywny"),
    ]
    answer = q.top_factors_answer(ranked).first()[0]
    assert "1. humidity (korelacja: 1.00, wpływ: pozytywny)." in answer or (
        "1. temperature (korelacja: -1.00, wpływ: negatywny)." in answer
    )
    none = q.top_factors_answer(q.top_factors(frame.limit(1), AS_OF)).first()[0]
    assert none.startswith("Brak wyraźnych korelacji")


def test_q12(spark):
    b = bikes(spark, {"temperature": 4.0}, {"cluster_prediction_success": False})
    v = buses(spark, {"temperature": 6.0})
    row = q.sector_success(b, v, AS_OF).first()
    assert (row["bike_rate"], row["bike_temp"], row["bus_rate"], row["bus_temp"], row["winner"]) == (
        50.0, 4.0, 100.0, 6.0, "bus",
    )
    assert "to 50.00%." in row["answer"]


def test_q13_ties_go_to_the_latest(spark):
    low = {"bikes_available": 2, "weather_condition": "Mist"}
    frame = bikes(
        spark,
        {**low, "name": "A", "timestamp": "2024-01-02 11:00:00"},
        {**low, "name": "B", "timestamp": "2024-01-02 11:10:00"},
        {"name": "B", "bikes_available": 8, "timestamp": "2024-01-02 11:20:00",
         "bike_regression_prediction": 2.5},
        {"name": "C", "bikes_available": 0, "weather_condition": "Sunny"},
    )
    row = q.station_needing_refill(frame, AS_OF).first()
    assert (row["name"], row["times_low"], row["bikes_available"]) == ("B", 1, 8)
    assert row["answer"].startswith("Stacja 'B' najprawdopodobniej wymagała")


def test_q14_answer(spark):
    wet = {"average_delay_seconds": 400.0, "precip_mm": 6.0, "weather_condition": "Heavy Rain"}
    frame = buses(spark, wet, wet, {**wet, "bus_line_number": "M"}, {**wet, "precip_mm": 5.0})
    ranked = q.rain_delay_lines(frame, AS_OF)
    answer = q.rain_delay_lines_answer(ranked).first()[0]
    assert answer.endswith("L (liczba zdarzeń: 2). M (liczba zdarzeń: 1).")
    assert q.rain_delay_lines_answer(ranked.limit(0)).first()[0].startswith("Brak danych")


def test_q15_sudden_increases(spark):
    frame = bikes(spark, *[
        {"timestamp": f"2024-01-02 11:0{i}:00", "docks_available": d, "fine_particles_pm2_5": p}
        for i, (d, p) in enumerate([(2, 1.0), (9, 3.0), (10, 1.0), (4, 1.0), (10, 5.0)])
    ])
    row = q.pollution_and_docks(frame, AS_OF).first()
    assert (row["sudden_increases"], row["mean_pm25"]) == (2, 4.0)
    assert "gwałtownie rosła: 4.00 µg/m³." in row["answer"]
    calm = q.pollution_and_docks(frame.limit(1), AS_OF).first()["answer"]
    assert calm.startswith("Brak zdarzeń")


def test_q16(spark):
    answer = q.optimization_summary(
        bikes(spark, {"summary_sentence": "x"}, {"summary_sentence": "", "timestamp": AS_OF}),
        buses(spark, {"summary_sentence": ""}), AS_OF,
    ).first()[0]
    assert "Podsumowanie dla rowerów: 'x'\n" in answer
    assert "autobusów: 'Brak podsumowań dla danych autobusowych.'" in answer


def test_question_set_skips_templates_without_values(spark):
    schema = "parameter STRING, value STRING"
    asked = templates.question_set(spark.createDataFrame([("station_name", "A")], schema)).collect()
    keys = sorted(re.match(r"q\d+", r["question_key"])[0] for r in asked)
    assert len(asked) == 9 + 2  # nine templates without parameter, two by station
    assert "q2" not in keys and "q6" not in keys and "q1" in keys
    texts = " ".join(r["question_text"] for r in asked)
    assert not re.search(r"\{\w+\}", texts)
    assert "ostatnich 2 godzin" in texts and "ostatnich 7 dni" in texts and "'A'" in texts


def test_ground_truth_for_every_question(spark):
    b, v = bikes(spark, {}, {"bikes_available": 2}), buses(spark, {})
    values = templates.parameter_values(b, v, AS_OF)
    extra = spark.createDataFrame([("cluster_id", "77")], "parameter STRING, value STRING")
    asked = templates.question_set(values.unionByName(extra))
    truth = templates.ground_truth(b, v, AS_OF)
    rows = templates.with_ground_truth(asked, truth).collect()
    assert {r["question_key"] for r in rows} == {t[0] for t in templates.TEMPLATES}
    found = {(r["question_key"].split("_")[0], r["value"]): r["ground_truth"] for r in rows}
    assert found["q2", "77"] == "Brak danych dla klastra o id '77' w ciągu ostatnich 2 godzin."
    assert found["q2", "1"].startswith("W ciągu ostatnich 2 godzin, 1 unikalnych autobusów")
    assert all(found.values())


def test_sample_is_bounded_and_repeatable(spark):
    rows = [{"name": f"S{i}"} for i in range(60)]
    frame = bikes(spark, *rows)
    first = [r[0] for r in templates.recent_values(frame, "name", AS_OF).collect()]
    again = [r[0] for r in templates.recent_values(frame.repartition(5), "name", AS_OF).collect()]
    assert len(first) == 20 and sorted(first) == sorted(again)
