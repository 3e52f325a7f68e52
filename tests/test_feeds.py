"""Feed documents to messages."""

import json

from pyspark.sql import functions as F

from velobus.operators import feeds
from velobus.plans import producers
from velobus.operators.records import replace_nulls, rename_columns, split_incomplete
from velobus.sources import feeds as sources


def land(folder, name, document, poll=0):
    target = folder / name
    target.mkdir(exist_ok=True)
    (target / f"{poll}.json").write_text(json.dumps(document))
    return str(target)


def test_polls_stay_apart(spark, tmp_path):
    """Files 9 and 10: by name 10 comes first, by time 9; neither poll sees the other's rows."""
    for poll, lat, delay in ((9, 1.0, 20), (10, 99.0, 120), (11, 5.0, None)):
        stop = {"vehicleId": 7, "tripId": 1, "routeId": 5, "headsign": "X", "delayInSeconds": delay}
        gps = land(tmp_path, "gps", {"vehicles": [{"vehicleId": 7, "lat": lat}]}, poll)
        stops = land(tmp_path, "stops", {"20": {"departures": [stop]}}, poll)
        info = land(tmp_path, "info", {"data": {"stations": [{"station_id": "s", "name": "N"}]}}, poll)
        bikes = {"data": {"stations": [{"station_id": "s", "num_bikes_available": poll}]}}
        status = land(tmp_path, "status", bikes, poll)
    buses = producers.bus_messages(spark, gps, stops, F.lit(1)).collect()
    found = sorted((r["lat"], [(s["stop_id"], s["delay"]) for s in r["estimated_stops"]]) for r in buses)
    assert found == [(1.0, [("20", 20)]), (5.0, [("20", None)]), (99.0, [("20", 120)])]
    stations = producers.station_messages(spark, info, status, None, F.lit(1)).collect()
    assert sorted(r["bikes_available"] for r in stations) == [9, 10, 11]


def test_station_merge(spark, tmp_path):
    info = land(tmp_path, "info", {"data": {"stations": [
        {"station_id": "s1", "name": "GDA001", "capacity": 10},
        {"station_id": "s2", "name": "GDY002", "capacity": 8},
        {"station_id": "s3", "name": "GDA000"},
    ]}})
    status = land(tmp_path, "status", {"data": {"stations": [
        {"station_id": "s1", "num_bikes_available": 3, "num_docks_available": 7,
         "vehicle_types_available": [{"vehicle_type_id": "bike", "count": 1},
                                     {"vehicle_type_id": "ebike", "count": 2}]},
        {"station_id": "s1", "num_bikes_available": 4, "num_docks_available": 6,
         "vehicle_types_available": [{"vehicle_type_id": "ebike", "count": 1},
                                     {"vehicle_type_id": "", "count": 9},
                                     {"vehicle_type_id": "ebike", "count": 3}]},
    ]}})
    merged = feeds.merge_stations(
        sources.station_info(sources.read_documents(spark, info)).drop("ord"),
        sources.station_status(sources.read_documents(spark, status)),
        F.col("ord"),
        "GDA",
        F.lit(5),
    )
    rows = feeds.project_types(merged).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [
        (5, "s3", "GDA000", 0, 0, 0, 0, 0),
        (5, "s1", "GDA001", 10, 4, 6, 0, 3),
    ]


def test_missing_path_gives_no_station(spark, tmp_path):
    path = land(tmp_path, "empty", {"data": {}})
    assert sources.station_info(sources.read_documents(spark, path)).count() == 0


def departures_document():
    def d(v, t, r, h, delay):
        return {"vehicleId": v, "tripId": t, "routeId": r, "headsign": h, "delayInSeconds": delay,
                "estimatedTime": "e", "theoreticalTime": "t"}

    return {
        "20": {"departures": [d(7, 1, 5, "X", 60), d(None, 9, 1, "N", 1)]},
        "10": {"departures": [d(7, 1, 5, "Z", -30), d(8, 2, 6, "Y", None), d(0, 3, 1, "O", 1)]},
    }


def test_trip_messages(spark, tmp_path):
    gps = land(tmp_path, "gps", {"vehicles": [
        {"vehicleId": 7, "routeShortName": "A", "headsign": ""},
        {"vehicleId": 7, "routeShortName": "B", "headsign": ""},
    ]})
    landed = land(tmp_path, "departures", departures_document())
    positions = sources.vehicle_positions(sources.read_documents(spark, gps))
    departures = sources.departures(sources.read_documents(spark, landed))
    located = feeds.attach_positions(
        departures, positions.withColumnRenamed("ord", "seen"), F.col("seen")
    )
    rows = {r["vehicle_id"]: r for r in feeds.trip_messages(located, F.lit(1)).collect()}
    assert set(rows) == {"7", "8"}
    first = rows["7"]
    assert (first["line"], first["headsign"], first["route_id"]) == ("B", "X", "5")
    assert [(s["stop_id"], s["delay"]) for s in first["estimated_stops"]] == [("20", 60), ("10", -30)]
    second = rows["8"]
    assert (second["line"], second["headsign"], second["lat"]) == (None, "Y", None)
    assert [(s["stop_id"], s["delay"]) for s in second["estimated_stops"]] == [("10", None)]

    filled = replace_nulls(rename_columns(feeds.trip_messages(located, F.lit(1))))
    bus = filled.where("vehicle_id = '8'").first()
    assert bus["bus_line_number"] == "unknown"
    assert [bus[c] for c in ("lat", "lon", "speed", "direction")] == [0.0] * 4


def test_weather_message_and_flattening(spark, tmp_path):
    path = land(tmp_path, "weather", {
        "location": {"lat": 54.3, "lon": 18.6},
        "current": {"temp_c": 7.0, "humidity": 80, "is_day": 1, "condition": {"text": "Mist"},
                    "air_quality": {"pm2_5": 1.5}},
    })
    message = feeds.weather_message(
        sources.weather(sources.read_documents(spark, path)), "Town", F.lit(1700000000)
    )
    row = feeds.flatten_environment(message).first()
    assert (row["city"], row["temperature"], row["is_day"], row["condition"], row["pm2_5"]) == (
        "Town", 7.0, "yes", "Mist", 1.5,
    )
    assert (row["type"], row["pm10"]) == ("environment", None)
    assert spark.sql("SELECT timestamp_seconds(1700000000)").first()[0] == row["timestamp"]


def test_daylight_flag(spark):
    frame = spark.createDataFrame([(1,), (0,), (None,)], "d INT")
    assert [r[0] for r in frame.select(feeds.daylight_flag(F.col("d"))).collect()] == [
        "yes", "no", "no",
    ]


def test_missing_key_differs_from_null(spark):
    frame = spark.createDataFrame([('{"c": 1}',), ('{"c": null}',), ("{}",)], "v STRING")
    found = frame.select(sources.default_when_missing(F.col("v"), "$.c", "int", 0)).collect()
    assert [r[0] for r in found] == [1, None, 0]


def test_incomplete_rows_are_split(spark):
    frame = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x INT, y STRING")
    complete, dropped = split_incomplete(frame)
    assert complete.count() == 1 and dropped.count() == 2
