"""Streams from message files to tables: ingest, scoring, quarantine, restart, model swap."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from velobus.ml import clusters, features, registry
from velobus.schemas import BIKE_MESSAGE, CLUSTER_BIKE_FEATURES, struct_type
from velobus.sinks import commits, log, tables
from velobus.sources import topics
from velobus.streaming import jobs


def environment_message(stamp, condition="Mist", **weather):
    return {
        "type": "environment", "timestamp": stamp,
        "location": {"city": "Town", "lat": 1.0, "lon": 2.0},
        "weather": {"temperature": 7.25, "feelslike": 6.0, "humidity": 80, "wind_kph": 10.0,
                    "precip_mm": 0.0, "cloud": 50, "visibility_km": 9.0, "uv_index": 1.0,
                    "is_day": "yes", "condition": condition, **weather},
        "air_quality": {"pm2_5": 3.0, "pm10": 4.0, "co": 200.0, "no2": 5.0, "o3": 6.0, "so2": 7.0},
    }


def bike_message(i, stamp, **changes):
    return {
        "timestamp": stamp, "station_id": f"s{i}", "name": f"ST{i}", "capacity": 10 + i % 3,
        "bikes_available": i % 10, "docks_available": 3,
        "vehicle_types_available": {"bike": 1, "ebike": 2}, **changes,
    }


def bus_message(i, stamp, delays, **changes):
    stops = [
        {"stop_id": str(j), "delay": d, "estimated_departure": "", "scheduled_departure": ""}
        for j, d in enumerate(delays)
    ]
    return {
        "timestamp": stamp, "vehicle_id": i, "line": "8", "headsign": "Port", "lat": 1.0,
        "lon": 2.0, "speed": 3.0, "direction": 4.0, "trip_id": 70 + i, "route_id": 5,
        "estimated_stops": stops, **changes,
    }


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    (folder / name).write_text(text + "\n")


def run(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def weather(spark, tmp_path):
    topic = tmp_path / "environment_topic"
    land(topic, "a.json", [environment_message(1000), "not json", environment_message(2000, "Rain"),
                           environment_message(2100, "Hot", temperature=1e9)])
    paths = jobs.Paths(str(tmp_path), "environment")
    run(jobs.ingest_environment(topics.file_topic(spark, str(topic)), paths))
    return paths


def test_environment_ingest(spark, weather):
    rows = weather.read(spark, "rows").orderBy("timestamp").collect()
    assert [r["condition"] for r in rows] == ["Mist", "Rain", "Hot"]
    assert float(rows[0]["temperature"]) == 7.25
    assert rows[2]["temperature"] is None
    bad = weather.read(spark, "quarantine").collect()
    assert [r["value"] for r in bad] == ["not json"]


def bikes_run(spark, tmp_path, weather, cache=None, files=None):
    paths = jobs.Paths(str(tmp_path), "bikes")
    values = topics.file_topic(spark, str(tmp_path / "bikes_topic"), files)
    run(jobs.run_sector(jobs.BIKES, values, weather, paths, "city", cache))
    return paths


def test_bike_stream_without_models(spark, tmp_path, weather):
    topic = tmp_path / "bikes_topic"
    land(topic, "a.json", [bike_message(1, 1100), bike_message(2, 1900, name=None),
                           bike_message(3, 1900, capacity=None), "{broken"])
    paths = bikes_run(spark, tmp_path, weather)
    rows = paths.read(spark, "rows").orderBy("station_id").collect()
    assert [(r["station_id"], r["name"], r["weather_condition"]) for r in rows] == [
        ("s1", "ST1", "Mist"), ("s2", "unknown", "Rain"),
    ]
    first = rows[0]
    assert (first["manual_bikes_available"], first["electric_bikes_available"]) == (1, 2)
    assert (first["cluster_id"], first["cluster_prediction_success"]) == (None, False)
    assert (first["bike_binary_label"], first["bike_regression_prediction_success"]) == (None, False)
    assert first["summary_sentence"].startswith("Stacja rowerowa 'ST1' (ID: s1)")

    documents = paths.read(spark, "documents").orderBy("metadata.station_id").collect()
    assert [d["workspace"] for d in documents] == ["city", "city"]
    assert documents[0]["text"] == first["summary_sentence"]
    assert documents[0]["metadata"]["cluster_id"] == "N/A"
    lost = {r["reason"]: r["record"] for r in paths.read(spark, "quarantine").collect()}
    assert lost["unreadable"] == "{broken"
    assert '"station_id":"s3"' in lost["missing value"]
    log = {(r["service"], r["level"], r["event"]): r["n"] for r in paths.read(spark, "log").collect()}
    assert log == {
        ("bikes", "INFO", "read"): 4, ("bikes", "INFO", "stored"): 2, ("bikes", "INFO", "clustered"): 0,
        ("bikes", "ERROR", "unreadable"): 1, ("bikes", "WARNING", "incomplete"): 1,
        ("bikes", "WARNING", "speechless"): 0,
    }


def test_restart_reads_only_new_files(spark, tmp_path, weather):
    topic = tmp_path / "bikes_topic"
    land(topic, "a.json", [bike_message(1, 1100)])
    bikes_run(spark, tmp_path, weather)
    land(topic, "b.json", [bike_message(2, 1100)])
    paths = bikes_run(spark, tmp_path, weather)
    rows = paths.read(spark, "rows")
    assert sorted(r["station_id"] for r in rows.collect()) == ["s1", "s2"]
    assert rows.select("batch_id").distinct().count() == 2


def test_no_weather_drops_everything(spark, tmp_path):
    land(tmp_path / "bikes_topic", "a.json", [bike_message(1, 1100)])
    nowhere = jobs.Paths(str(tmp_path), "environment")
    paths = bikes_run(spark, tmp_path, nowhere)
    assert paths.read(spark, "quarantine").count() == 1
    assert paths.read(spark, "rows", "x INT").count() == 0


def test_bus_stream_equals_batch(spark, tmp_path, weather):
    topic = tmp_path / "buses_topic"
    for part in range(4):
        land(topic, f"{part}.json", [
            bus_message(10 * part + i, 1000 + 97 * i, [0, 60, -30, 120, None][: i + 1])
            for i in range(5)
        ] + [bus_message(99, 1000, [1], trip_id=None)])
    paths = jobs.Paths(str(tmp_path), "buses")
    values = topics.file_topic(spark, str(topic), 1)
    run(jobs.run_sector(jobs.BUSES, values, weather, paths, "city"))
    stored = paths.read(spark, "rows").drop("run", "attempt", "batch_id", "event_date")
    assert paths.read(spark, "rows").select("batch_id").distinct().count() == 4

    good, bad = topics.messages(spark.read.text(str(topic)), "buses")
    assert bad.count() == 0
    environment = jobs.read_environment(spark, weather.rows)
    scored, dropped = jobs.score_records(jobs.BUSES, good, environment, {})
    batch = scored.drop("metadata").withColumn("timestamp", F.col("event_time")).drop("event_time")
    columns = sorted(batch.columns)
    assert sorted(stored.columns) == columns
    assert sorted(map(str, stored.select(columns).collect())) == sorted(
        map(str, batch.select(columns).collect())
    )
    assert dropped.count() == 4
    full = batch.where("vehicle_id = '4'").first()
    assert (full["average_delay_seconds"], full["delay_trend"], full["stops_count"]) == (
        37.5, "increasing", 5,
    )


def test_repeated_batch_is_not_stored_twice(spark, tmp_path):
    frame = spark.range(5).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    path = str(tmp_path / "rows")
    for _ in range(2):
        tables.write_dated_batch(frame, path, 3)
    tables.write_dated_batch(frame, path, 4)
    assert spark.read.parquet(path).count() == 10


def test_publish_and_read_back(spark, tmp_path):
    rows = [tuple(bike_message(1, 5).values())]
    messages = spark.createDataFrame(rows, struct_type(BIKE_MESSAGE))
    path = str(tmp_path / "topic")
    tables.publish_files(messages, path)
    good, bad = topics.messages(spark.read.text(path), "bikes")
    assert good.collect() == messages.collect()
    assert bad.count() == 0


def bike_model(spark, weather, seed):
    lines = [(json.dumps(bike_message(i, 1000 + i)),) for i in range(40)]
    good, _ = topics.messages(spark.createDataFrame(lines, "value STRING"), "bikes")
    records = jobs.prepare_bikes(good, jobs.read_environment(spark, weather.rows))
    rows = features.complete_rows(records, CLUSTER_BIKE_FEATURES)
    preparation = features.feature_pipeline(rows, CLUSTER_BIKE_FEATURES)
    vectors = preparation.transform(rows).select("features")
    model = clusters.fit_kmeans(vectors, 2, restarts=2, seed=seed)
    return PipelineModel(stages=[*preparation.stages, model])


def test_models_are_swapped_between_batches(spark, tmp_path, weather):
    reg = registry.Registry(spark, str(tmp_path / "models"))
    reg.seed()
    reg.seed()
    assert reg.versions().count() == 8
    cache = registry.ModelCache(reg)
    topic = tmp_path / "bikes_topic"

    land(topic, "a.json", [bike_message(1, 1100)])
    bikes_run(spark, tmp_path, weather, cache)
    assert reg.publish("bikes_kmeans", bike_model(spark, weather, 1), 0.5) == 2
    status = reg.status().where("model_name = 'bikes_kmeans'").first()
    assert status["is_new_model_available"] and status["version"] == 2

    land(topic, "b.json", [bike_message(i, 1100) for i in range(2, 6)])
    bikes_run(spark, tmp_path, weather, cache)
    status = reg.status().where("model_name = 'bikes_kmeans'").first()
    assert not status["is_new_model_available"] and status["version"] == 2
    assert status["quality_metric"] == 0.5
    first_path = cache.loaded["bikes_kmeans"][0]

    reg.publish("bikes_kmeans", bike_model(spark, weather, 2), 0.6)
    land(topic, "c.json", [bike_message(6, 1100, name="new")])
    paths = bikes_run(spark, tmp_path, weather, cache)
    assert cache.loaded["bikes_kmeans"][0] != first_path
    rows = {r["station_id"]: r for r in paths.read(spark, "rows").collect()}
    assert rows["s1"]["cluster_id"] is None
    assert all(rows[f"s{i}"]["cluster_id"] in (0, 1) for i in range(2, 7))
    assert "Stacja została przypisana do klastra" in rows["s6"]["summary_sentence"]


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path, weather):
    """The checkpoint is lost, the stream starts anew from other messages: both runs' rows are there."""
    topic = tmp_path / "bikes_topic"
    land(topic, "a.json", [bike_message(1, 1100)])
    paths = bikes_run(spark, tmp_path, weather)
    (tmp_path / "bikes" / "checkpoint").rename(tmp_path / "lost")
    (topic / "a.json").rename(tmp_path / "a.json")
    land(topic, "b.json", [bike_message(2, 1100)])
    bikes_run(spark, tmp_path, weather)
    rows = paths.read(spark, "rows").collect()
    assert sorted((r["station_id"], r["batch_id"]) for r in rows) == [("s1", 0), ("s2", 0)]
    assert len({r["run"] for r in rows}) == 2


def test_a_crash_between_the_sinks_is_repaired(spark, tmp_path, weather, monkeypatch):
    """Documents are written, rows are not: nothing is read until the batch has gone through whole."""
    topic = tmp_path / "bikes_topic"
    land(topic, "a.json", [bike_message(1, 1100), bike_message(2, 1100)])
    paths = jobs.Paths(str(tmp_path), "bikes")

    def broken(frame, folder):
        tables.write_plain(frame, folder)
        raise RuntimeError("lost after writing")

    whole = tables.write_dated
    monkeypatch.setattr(tables, "write_dated", broken)
    values = topics.file_topic(spark, str(topic))
    query = jobs.run_sector(jobs.BIKES, values, weather, paths, "city")
    with pytest.raises(Exception, match="lost after writing"):
        query.awaitTermination()
    assert list((tmp_path / "bikes" / "documents").rglob("*.json"))
    assert paths.read(spark, "documents", "text STRING").count() == 0
    assert paths.read(spark, "rows", "station_id STRING").count() == 0
    monkeypatch.setattr(tables, "write_dated", whole)
    bikes_run(spark, tmp_path, weather)
    assert paths.read(spark, "documents").count() == paths.read(spark, "rows").count() == 2


def test_a_committed_batch_is_not_written_again(spark, tmp_path, weather):
    """The stream's own note of the batch is lost after the commit: it is repeated and skipped."""
    land(tmp_path / "bikes_topic", "a.json", [bike_message(1, 1100)])
    paths = bikes_run(spark, tmp_path, weather)
    for name in ("0", ".0.crc"):
        note = tmp_path / "bikes" / "checkpoint" / "commits" / name
        if note.exists():
            note.rename(tmp_path / f"note{name}")
    bikes_run(spark, tmp_path, weather)
    assert paths.read(spark, "rows").count() == 1
    assert len(list((tmp_path / "bikes" / "rows").rglob("attempt=*"))) == 1


def test_weather_read_does_not_grow_with_history(spark, tmp_path):
    """A year of hourly weather: a batch reads the days it spans and one on either side."""
    topic = tmp_path / "environment_topic"
    for month in range(4):
        land(topic, f"{month}.json", [environment_message(86_400 * (30 * month + d) + 60 * m) for d in range(30) for m in (5, 700)])
    paths = jobs.Paths(str(tmp_path), "environment")
    run(jobs.ingest_environment(topics.file_topic(spark, str(topic), 1), paths))
    assert paths.read(spark, "rows").count() == 240
    whole = paths.read(spark, "rows")
    for first, last, most in ((86_400 * 40 + 10, 86_400 * 41 + 5, 8), (86_400 * 500, 86_400 * 501, 2), (-86_400 * 3, -86_400 * 2, 2)):
        facts = spark.createDataFrame([(first,), ((first + last) // 2,), (last,)], "s BIGINT").selectExpr("timestamp_seconds(s) AS at")
        near = jobs.environment_near(spark, paths, facts, "at")
        assert 0 < near.count() <= most
        read = [jobs.enrich_with_environment(facts.withColumnRenamed("at", "event_time"), w) for w in (near, whole)]
        assert sorted(map(str, read[0].collect())) == sorted(map(str, read[1].collect()))
    assert jobs.environment_near(spark, paths, facts.where("false"), "at").count() == 0


def test_records_are_created_once(spark, tmp_path):
    folder = str(tmp_path / "records")
    assert commits.records(spark, folder) == {}
    assert commits.commit(spark, folder, "a", {"x": 1})
    assert not commits.commit(spark, folder, "a", {"x": 2})
    (tmp_path / "records" / "cut.json").write_text('{"x": ')
    assert commits.records(spark, folder) == {"a": {"x": 1}}


def test_streams_are_logged_from_outside(spark, tmp_path):
    import time

    listener = log.StreamLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(listener)
    try:
        land(tmp_path / "in", "a.json", ["x", "y"])
        stream = topics.file_topic(spark, str(tmp_path / "in")).writeStream.queryName("letters")
        run(stream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        for _ in range(100):
            time.sleep(0.2)
            seen = spark.read.schema(log.LOG_TABLE).parquet(str(tmp_path / "log")).collect() if (tmp_path / "log").exists() else []
            if any(r["event"] == "ended" for r in seen):
                break
    finally:
        spark.streams.removeListener(listener)
    assert {("letters", "started", 1), ("letters", "batch", 2)} <= {(r["service"], r["event"], r["n"]) for r in seen}
