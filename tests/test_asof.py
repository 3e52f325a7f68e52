"""Nearest reading, segmented lag and hash rank against brute force."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from velobus.operators.asof import nearest_join
from velobus.operators import ordered
from velobus.operators.ordered import first_by_hash, previous_value, with_slice

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def join(spark, facts, readings, **options):
    f = spark.createDataFrame([(i, at(s)) for i, s in enumerate(facts)], "id INT, ts TIMESTAMP")
    r = spark.createDataFrame(
        [(i, at(s), s) for i, s in enumerate(readings)], "rid INT, rts TIMESTAMP, v INT"
    )
    rows = nearest_join(f, r, "ts", "rts", ["v"], reading_order="rid", **options)
    return [x["v"] for x in rows.orderBy("id").collect()]


@pytest.mark.parametrize("slices", [2, 8, 64])
def test_golden(spark, slices):
    facts = [-1000, 149, 150, 151, 450, 451, 10**6]
    assert join(spark, facts, [0, 300, 600], slices=slices) == [0, 0, 0, 300, 300, 600, 600]


def test_no_reading_gives_null(spark):
    assert join(spark, [1, 2], []) == [None, None]


@pytest.mark.parametrize("slices", [2, 16])
def test_against_brute_force(spark, slices):
    rng = random.Random(3)
    # A third of all facts share one stamp, and a third lie within one minute.
    facts = [5000] * 200 + [rng.randint(9000, 9060) for _ in range(200)]
    facts += [rng.randint(0, 20000) for _ in range(200)]
    readings = [rng.randint(0, 20000) for _ in range(90)] + [5000, 5000]
    expected = [min(readings, key=lambda r: (abs(r - f), r)) for f in facts]
    assert join(spark, facts, readings, slices=slices) == expected


def test_stored_map_is_broadcast(spark):
    facts = [5] * 50 + [400]
    assert join(spark, facts, [0, 300], stored=True) == [0] * 50 + [300]


def test_known_by(spark):
    assert join(spark, [100], [0, 90], known_by=F.lit(at(50))) == [0]


def test_smallest_reading_id_wins(spark):
    f = spark.createDataFrame([(at(0),)], "ts TIMESTAMP")
    r = spark.createDataFrame([(2, at(5), "b"), (1, at(5), "a")], "rid INT, rts TIMESTAMP, v STRING")
    assert nearest_join(f, r, "ts", "rts", ["v"], reading_order="rid").first()["v"] == "a"


def test_slices_are_even(spark):
    frame = with_slice(spark.range(10000).repartition(4), F.col("id"), "s", 16)
    sizes = [r["count"] for r in frame.groupBy("s").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("slices", [2, 8, 33])
def test_previous_value(spark, slices):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.randint(0, 300), i,
             rng.choice([None, 1, 2, 3])) for i in range(600)]
    expected, last = {}, {}
    for key, place, i, value in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i] = last.get(key)
        last[key] = value
    frame = spark.createDataFrame(rows, "k STRING, p INT, i INT, v INT").repartition(6)
    found = previous_value(frame, ["k"], F.col("p").cast("bigint"), ["i"], "v", "before", slices)
    assert {r["i"]: r["before"] for r in found.collect()} == expected


def test_first_by_hash(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(1000, None)]
    frame = spark.createDataFrame(rows, "id INT, g STRING").repartition(5)
    found = first_by_hash(frame, "id", ["g"], "7", F.floor((F.col("size") + 4) / 5), "first")
    groups = {}
    for i, g in rows:
        groups.setdefault(g, []).append((hashlib.md5(f"7{i}".encode()).hexdigest(), i))
    expected = {
        i: rank < -(-len(members) // 5)
        for members in groups.values()
        for rank, (_, i) in enumerate(sorted(members))
    }
    assert {r["id"]: r["first"] for r in found.collect()} == expected


def test_first_by_hash_narrows_step_by_step(spark, monkeypatch):
    rows = [(i, i % 2) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id INT, g INT")
    for steps in ((1,), (1, 2), (1, 2, 3, 4)):
        monkeypatch.setattr(ordered, "PREFIXES", steps)
        found = first_by_hash(frame, "id", ["g"], "7", F.lit(333), "first")
        for g in (0, 1):
            ids = sorted((i for i, of in rows if of == g), key=lambda i: hashlib.md5(f"7{i}".encode()).hexdigest())
            assert {r["id"] for r in found.where(f"first and g = {g}").collect()} == set(ids[:333])


def test_copies_of_an_id_stay_together(spark):
    rows = [(i if i % 3 else 3,) for i in range(300)]
    frame = spark.createDataFrame(rows, "id INT")
    found = first_by_hash(frame.withColumn("g", F.lit(1)), "id", ["g"], "7", F.lit(60), "first")
    flags = {r["id"]: r["first"] for r in found.select("id", "first").distinct().collect()}
    assert len(flags) == 201
    assert 60 <= found.where("first").count() <= 160


def test_null_key_is_no_series(spark):
    frame = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k STRING, p INT, v INT")
    found = previous_value(frame, ["k"], F.col("p").cast("bigint"), [], "v", "before", 2)
    assert {r["before"] for r in found.collect()} == {None}
