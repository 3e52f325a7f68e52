"""Sentences, titles, metadata, display time."""

from pyspark.sql import functions as F

from velobus.functions.text import bike_metadata, bike_sentence, bus_metadata, bus_sentence, display_time
from velobus.sinks.tables import with_title


def one(spark, schema, values, build):
    frame = spark.createDataFrame([values], schema)
    return frame.select(build(frame)).first()[0]


def test_display_time(spark):
    frame = spark.createDataFrame([("1700000000",), ("1700000000000",), (None,), ("x",)], "t STRING")
    assert [r[0] for r in frame.select(display_time(F.col("t"))).collect()] == [
        "2023-11-14 22:13", "2023-11-14 22:13", "Brak czasu", "Nieznany czas",
    ]


STATION = (
    "name STRING, station_id STRING, capacity INT, bikes_available INT, docks_available INT, "
    "manual_bikes_available INT, electric_bikes_available INT"
)
BASE = ("GDA001", "s1", 10, 4, 6, 0, 3)
TEXT = (
    "Stacja rowerowa 'GDA001' (ID: s1) o pojemności 10 miejsc. Aktualnie dostępnych jest 4 rowerów "
    "(w tym 0 manualnych i 3 elektrycznych) oraz 6 wolnych doków."
)


def test_bike_sentence(spark):
    assert one(spark, STATION, BASE, bike_sentence) == TEXT


def test_bike_sentence_with_weather(spark):
    schema = STATION + ", weather_condition STRING, temperature DOUBLE, wind_kph DOUBLE, precip_mm DOUBLE"
    found = one(spark, schema, BASE + ("Mist", 7.0, 10.0, 0.0), bike_sentence)
    assert found == TEXT + " Aktualne warunki pogodowe: Mist, temperatura: 7.0°C, wiatr: 10.0 km/h."


def test_bike_sentence_variants(spark):
    schema = "name STRING, station_id STRING, capacity INT, bikes_available INT, docks_available INT"

    def say(*values):
        return one(spark, schema, values, bike_sentence)

    assert say(None, "s", None, None, 3) == "Stacja rowerowa o ID s. Wolnych doków: 3."
    assert say("n", "s", None, 2, None) == "Stacja rowerowa 'n' (ID: s). Dostępnych rowerów: 2."
    assert say("", "", 5, None, None) == "Nieznana stacja rowerowa."


def test_clipped_forecast_is_said(spark):
    schema = (
        "station_id STRING, bike_regression_prediction DOUBLE, "
        "bike_regression_prediction_original DOUBLE"
    )
    found = one(spark, schema, ("s", 0.0, -2.0), bike_sentence)
    assert found.endswith(
        "Przewidywana liczba dostępnych rowerów w przyszłości: 0. "
        "(Prognoza była ujemna i została obcięta do zera)."
    )


def test_bus_sentence(spark):
    schema = (
        "bus_line_number STRING, route_destination STRING, trip_identifier STRING, cluster_id INT, "
        "is_late_label STRING, delay_category_label STRING, average_delay_seconds_prediction DOUBLE, "
        "fine_particles_pm2_5 DOUBLE, coarse_particles_pm10 DOUBLE"
    )
    found = one(spark, schema, ("8", "Port", "77", 2, "spóźniony", "lekko spóźniony", 12.0, 3.0, 4.0),
                bus_sentence)
    assert found == (
        "Przejazd autobusu linii 8 (ID podróży: 77) w kierunku Port. Został przypisany do klastra 2. "
        "Przewidywany status: spóźniony. Kategoria opóźnienia: lekko spóźniony. "
        "Przewidywane opóźnienie: 12 sekund. Jakość powietrza: PM2.5 na poziomie 3.0 µg/m³, "
        "PM10 na poziomie 4.0 µg/m³."
    )
    assert one(spark, "bus_line_number STRING", ("8",), bus_sentence) == (
        "Autobus linii 8 w kierunku nieznany cel."
    )


def test_metadata(spark):
    bike = one(spark, "timestamp BIGINT, name STRING, station_id STRING, capacity INT",
               (1700000000, "n", "s", 4), bike_metadata)
    assert len(bike) == 38
    assert bike["title"] == "Dane dla stacji: n (ID: s) - 2023-11-14 22:13"
    assert (bike["capacity"], bike["cluster_id"]) == ("4", "N/A")
    bus = one(spark, "timestamp BIGINT, vehicle_id STRING, is_late_probabilities ARRAY<DOUBLE>",
              (1700000000, "v", [0.5, 0.5]), bus_metadata)
    assert len(bus) == 55
    assert bus["is_late_probabilities"] == "[0.5,0.5]"
    assert bus["title"] == "Autobus Linii Brak Linii (v) - Cel: Brak Celu - 2023-11-14 22:13"


def test_title_is_added_when_absent(spark):
    frame = spark.createDataFrame([({"a": "1"},), ({"title": "t"},)], "m MAP<STRING,STRING>")
    found = [r[0] for r in frame.select(with_title(F.col("m"), F.lit("new"))).collect()]
    assert found == [{"title": "new", "a": "1"}, {"title": "t"}]
