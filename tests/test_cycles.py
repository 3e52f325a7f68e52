"""From landed feeds to scored rows: producers, streams, training cycles, promotion."""

import json
import random

from pyspark.sql import functions as F

from tests.test_feeds import departures_document, land
from tests.test_streaming import bike_message, bus_message, environment_message
from velobus.ml import cycles, registry
from velobus.plans import producers
from velobus.session import wide_records
from velobus.sinks import tables
from velobus.sources import topics
from velobus.streaming import jobs


def test_producers_publish_and_count(spark, tmp_path):
    gps = land(tmp_path, "gps", {"vehicles": [{"vehicleId": 7, "routeShortName": "A"}]})
    stops = land(tmp_path, "stops", departures_document())
    out = str(tmp_path / "buses")
    messages = producers.bus_messages(spark, gps, stops, F.lit(9))
    assert producers.publish(messages, lambda m: tables.publish_files(m, out)) == producers.Published(2, 2, 0)
    good, bad = topics.messages(spark.read.text(out), "buses")
    assert sorted(r["trip_id"] for r in good.collect()) == ["1", "2"] and bad.count() == 0

    info = land(tmp_path, "info", {"data": {"stations": [{"station_id": "b", "name": "GDA2"},
                                                         {"station_id": "a", "name": "GDA1"}]}})
    status = land(tmp_path, "status", {"data": {"stations": []}})
    stations = producers.station_messages(spark, info, status, "GDA", F.lit(9))
    assert [r["name"] for r in stations.collect()] == ["GDA1", "GDA2"]
    assert [r["vehicle_types_available"] for r in stations.collect()] == [{}, {}]

    weather = land(tmp_path, "weather", {"location": {"lat": 1.0, "lon": 2.0}, "current": {"temp_c": 3.0}})
    row = producers.environment_messages(spark, weather, "Town", F.lit(9)).first()
    assert (row["weather"]["temperature"], row["weather"]["is_day"]) == (3.0, "no")


def stored(spark, tmp_path, sector, lines):
    environment = [environment_message(1000 + 50 * i, random.Random(i).choice(["Mist", "Rain"]),
                                       temperature=float(i)) for i in range(40)]
    values = spark.createDataFrame([(json.dumps(m),) for m in environment], "value STRING")
    parsed, _ = topics.messages(values, "environment")
    weather = jobs.flatten_environment(parsed)
    values = spark.createDataFrame([(json.dumps(m),) for m in lines], "value STRING")
    messages, _ = topics.messages(values, sector.topic)
    path = str(tmp_path / "stored")
    with wide_records(spark):
        scored, _ = jobs.score_records(sector, messages, weather, {})
        rows = scored.drop("metadata").withColumn("timestamp", F.col("event_time"))
        tables.write_dated_batch(rows.drop("event_time"), path, 0)
    return spark.read.parquet(path)


def test_bike_cycles(spark, tmp_path):
    rng = random.Random(2)
    lines = [bike_message(i, 1000 + 17 * i, capacity=20, bikes_available=rng.randint(0, 20))
             for i in range(120)]
    table = stored(spark, tmp_path, jobs.BIKES, lines)
    reg = registry.Registry(spark, str(tmp_path / "models"))
    reg.seed()
    as_of = "1970-01-02"
    quality = cycles.cluster_cycle(table, "bikes", reg, as_of, range(2, 4), restarts=1)
    assert 0 <= quality <= 1
    results = cycles.class_cycle(table, "bikes", reg, as_of, trees=3, depth=3)
    assert all(r.model is not None for r in results.values())
    waiting = reg.status().where("is_new_model_available")
    assert waiting.count() == 4

    models = registry.ModelCache(reg).refresh()
    assert set(models) == {"bikes_kmeans", *results}
    assert reg.status().where("is_new_model_available").count() == 0
    records = table.drop(*[c for c in table.columns if "prediction" in c or "label" in c
                           or "probabilities" in c or c in ("cluster_id", "summary_sentence")])
    with wide_records(spark):
        row = jobs.score_bikes(records, models).first()
    assert row["bike_binary_prediction_success"] and row["bike_multiclass_label"]
    assert row["bike_regression_prediction"] >= 0 and row["cluster_id"] is not None


def test_bus_cycles(spark, tmp_path):
    rng = random.Random(3)
    lines = [bus_message(i, 1000 + 17 * i, [rng.randint(-200, 600) for _ in range(4)])
             for i in range(120)]
    table = stored(spark, tmp_path, jobs.BUSES, lines)
    reg = registry.Registry(spark, str(tmp_path / "models"))
    as_of = "1970-01-02"
    cycles.cluster_cycle(table, "buses", reg, as_of, range(2, 3), restarts=1)
    rows, features = cycles.class_rows(table, "buses", as_of)
    assert "delay_trend" in features and rows.count() == 120
    results = cycles.class_cycle(table, "buses", reg, as_of, trees=3, depth=3)
    assert results["bus_binary_classifier"].quality > 0.5
    assert reg.status().count() == 4


def test_messages_that_cannot_be_sent_are_set_aside(spark, tmp_path):
    rows = [("a", "short"), (None, "no id"), ("b", "x" * 300), ("c", None)]
    messages = spark.createDataFrame(rows, "station_id STRING, name STRING")
    out, aside = str(tmp_path / "out"), str(tmp_path / "aside")
    done = producers.publish(
        messages, lambda m: tables.publish_files(m, out), lambda m: tables.publish_files(m, aside),
        required=["station_id"], max_bytes=100,
    )
    assert done == producers.Published(4, 2, 2)
    assert sorted(json.loads(r["value"])["station_id"] for r in spark.read.text(out).collect()) == ["a", "c"]
    assert spark.read.text(aside).count() == 2
    assert done.log("job") == [("job", "INFO", "total", 4), ("job", "INFO", "sent", 2), ("job", "ERROR", "failed", 2)]
    nothing = producers.publish(messages.limit(0), lambda m: tables.publish_files(m, out))
    assert nothing == producers.Published(0, 0, 0)


def test_weather_producer_streams_landed_documents(spark, tmp_path):
    landing, out, log_path = (str(tmp_path / n) for n in ("landing", "topic", "log"))
    (tmp_path / "landing").mkdir()
    for poll in (100, 200):
        document = {"location": {"lat": 1.0, "lon": 2.0}, "current": {"temp_c": poll / 10}}
        (tmp_path / "landing" / f"{poll}.json").write_text(json.dumps(document))
        run = producers.environment_producer(spark, landing, "Town", lambda m: tables.publish_files(m, out), str(tmp_path / "c"), log_path)
        run.awaitTermination()
    good, bad = topics.messages(spark.read.text(out), "environment")
    assert sorted(r["weather"]["temperature"] for r in good.collect()) == [10.0, 20.0] and bad.count() == 0
    counts = spark.read.parquet(log_path).groupBy("event").agg(F.sum("n").alias("n")).collect()
    assert {r["event"]: r["n"] for r in counts} == {"total": 2, "sent": 2, "failed": 0}


def test_two_trainers_never_get_one_version(spark, tmp_path, monkeypatch):
    """The second trainer has read the registry before the first appended its row."""
    from pyspark.ml.feature import VectorAssembler

    reg = registry.Registry(spark, str(tmp_path / "models"))
    reg.seed()
    before = spark.createDataFrame(reg.versions().collect(), reg.versions().schema)
    model = VectorAssembler(inputCols=["x"], outputCol="y")
    assert reg.publish("bikes_kmeans", model, 0.1) == 2
    with monkeypatch.context() as stale:
        stale.setattr(reg, "versions", lambda: before)
        assert reg.publish("bikes_kmeans", model, 0.2) == 3
    rows = reg.versions().where("model_name = 'bikes_kmeans'").collect()
    assert sorted(r["version"] for r in rows) == [1, 2, 3]
    assert len({r["path"] for r in rows}) == 3


def test_keyed_table(spark, tmp_path, monkeypatch):
    from velobus.sinks import commits, keyed

    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k INT, x STRING", ["k"])

    def state(version=None):
        return [tuple(r) for r in table.read(version).collect()]

    def rows(*pairs):
        return spark.createDataFrame(pairs, "k INT, x STRING")

    assert (state(), table.version()) == ([], 0)
    assert table.append(rows((1, "a"), (2, "b"), (None, "n"))) == 1
    assert table.append(rows((2, "c"), (3, None))) == 2
    now = [(1, "a"), (2, "c"), (3, None), (None, "n")]
    assert sorted(map(str, state())) == sorted(map(str, now))
    # A writer that read the records before another's claim takes the next number.
    with monkeypatch.context() as stale:
        stale.setattr(table, "_records", lambda: [])
        assert table.append(rows((4, "d"))) == 3
    assert table.compact() == 4
    # A delta written while the base was being built is newer than the base.
    part = "late"
    rows((1, "z")).write.parquet(f"{table.data}/part={part}")
    assert commits.commit(spark, table.claims, f"{5:012d}", {"part": part, "covers": None})
    assert (1, "z") in [tuple(r) for r in table.read().collect()] and table.read().count() == 5
    assert sorted(map(str, state(2))) == sorted(map(str, now))
    # A folder without a record is no part of the table.
    rows((9, "ghost")).write.parquet(f"{table.data}/part=ghost")
    assert table.read().count() == 5
