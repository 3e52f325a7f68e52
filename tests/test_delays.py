"""Delay statistics: golden cases, and list form = row form."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velobus.operators.delays import delay_statistics, delay_trend, with_delay_statistics
from velobus.schemas import BUS_MESSAGE, DELAY_COLS


def message(delays, trip="t"):
    stops = None if delays is None else [(f"s{i}", d, "", "") for i, d in enumerate(delays)]
    return (1, "v", "L", "H", 1.0, 2.0, 3.0, 4.0, trip, "r", stops)


def listed(spark, *cases):
    rows = [message(d, str(i)) for i, d in enumerate(cases)]
    frame = with_delay_statistics(spark.createDataFrame(rows, BUS_MESSAGE))
    assert "estimated_stops" not in frame.columns
    return [r.asDict() for r in frame.orderBy(F.col("trip_id").cast("int")).collect()]


def test_golden_list(spark):
    row = listed(spark, [0, 60, -30, 120, None])[0]
    assert [row[c] for c in DELAY_COLS] == [
        5, 37.5, 120, -30, 4425.0, 66.52, 150, 1, 1, 2, "increasing", 0.0, 0.25, 90.0, -30.0,
    ]


@pytest.mark.parametrize(
    "delays, trend",
    [
        ([1, 2], "increasing"),
        ([2, 1], "decreasing"),
        ([1, 2, 1], "stable"),
        ([0, 1, 0, 1, 0, 1], "stable"),
        ([5], "stable"),
        ([], "stable"),
        (None, "stable"),
        ([None, None], "stable"),
    ],
)
def test_trend(spark, delays, trend):
    assert listed(spark, delays)[0]["delay_trend"] == trend


def test_empty_and_unknown(spark):
    for delays, stops in ([], 0), (None, 0), ([None, None], 2):
        row = listed(spark, delays)[0]
        assert [row[c] for c in DELAY_COLS] == [
            stops, 0.0, 0, 0, 0.0, 0.0, 0, 0, 0, 0, "stable", 1.0, 0.0, 0.0, 0.0,
        ]


def test_single_value(spark):
    row = listed(spark, [5])[0]
    assert (row["delay_variance"], row["consistency_score"], row["punctuality_ratio"]) == (0, 1, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-900, 900)), min_size=1, max_size=9),
                min_size=1, max_size=12))
def test_list_form_equals_row_form(spark, trips):
    expected = listed(spark, *trips)
    rows = [(t, i, d) for t, delays in enumerate(trips) for i, d in enumerate(delays)]
    flat = spark.createDataFrame(rows, "trip INT, place INT, delay INT").repartition(5)
    found = delay_statistics(flat, ["trip"], position=["place"]).orderBy("trip").collect()
    assert [[r[c] for c in DELAY_COLS] for r in found] == [
        [r[c] for c in DELAY_COLS] for r in expected
    ]


def test_trend_ignores_copies(spark):
    rows = [(1, 0, 5), (1, 1, 9), (1, 1, 9), (1, 2, 7)]
    frame = spark.createDataFrame(rows, "trip INT, place INT, delay INT")
    row = delay_trend(frame, ["trip"], ["place"]).first()
    assert (row["rises"], row["falls"], row["delay_trend"]) == (1, 1, "stable")


def test_fractions_are_refused(spark):
    frame = spark.createDataFrame([(1, 2.5)], "trip INT, delay DOUBLE")
    with pytest.raises(TypeError):
        delay_statistics(frame, ["trip"])
    nested = frame.select(F.array(F.struct("delay")).alias("estimated_stops"))
    with pytest.raises(TypeError):
        with_delay_statistics(nested)


def test_trend_of_a_large_trip_in_stretches(spark):
    """One trip with most of the rows is cut into stretches; every cut gives the same trend."""
    import random

    rng = random.Random(4)
    rows = [("hot", i // 3, i, rng.choice([None, *range(5)])) for i in range(3000)]
    rows += [(f"t{i % 40}", i, i, rng.randrange(3)) for i in range(400)] + [(None, 1, 1, 1), (None, 2, 2, 2)]
    frame = spark.createDataFrame(rows, "trip STRING, at INT, tie INT, delay INT").repartition(5)
    want = {}
    for trip in {r[0] for r in rows}:
        d = [r[3] for r in sorted((r for r in rows if r[0] == trip), key=lambda r: r[1:3]) if r[3] is not None]
        steps = [b - a for a, b in zip(d, d[1:])]
        want[trip] = (sum(s > 0 for s in steps), sum(s < 0 for s in steps))
    for slices in (2, 16):
        found = delay_trend(frame, ["trip"], ["at", "tie"], slices=slices)
        assert {r["trip"]: (r["rises"], r["falls"]) for r in found.collect()} == want
    assert delay_trend(frame.limit(0), ["trip"], ["at", "tie"]).count() == 0
    stamped = frame.withColumn("at", F.timestamp_seconds("at"))
    found = delay_trend(stamped, ["trip"], ["at", "tie"], slices=8)
    assert {r["trip"]: (r["rises"], r["falls"]) for r in found.collect()} == want


def test_tasks_are_packed_to_a_bounded_size(spark):
    """A task of a trip's join, aggregation and sort takes many times what it reads."""
    from velobus import session

    before = spark.conf.get(session.ADVISORY)
    try:
        for given, want in (("64MB", 16 << 20), ("1g", 16 << 20), ("67108864b", 16 << 20), ("8m", 8 << 20), ("16k", 16 << 10)):
            spark.conf.set(session.ADVISORY, given)
            session.tune(spark)
            assert session._bytes(spark.conf.get(session.ADVISORY)) == want
    finally:
        spark.conf.set(session.ADVISORY, before)
