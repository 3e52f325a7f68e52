"""Physical plans: no pair-building joins, pruned scans, pushed filters, few exchanges."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from velobus.bindings.registry import Tables
from velobus.bindings.views import buses_view
from velobus.operators.delays import delay_statistics
from velobus.operators.ordered import first_by_hash
from velobus.plans import questions as q
from velobus.sinks.tables import write_dated_batch

# These run their jobs while they are built; what they return only reads the result.
EAGER = {
    "kmeans_k", "kmeans_profile", "kmeans_score", "clf_score", "reg_score", "stream_equals_batch",
    "stream_windows", "document_feed",
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - EAGER))
def test_no_pair_building_join(spark, folder, key):
    text = plan(entry.queries()[key](spark, folder))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_time_bound_reaches_the_scan(spark, folder):
    orders = Tables(spark, folder).orders
    frame = q.within(orders, "2001-01-01", days=30, time="o_orderdate").select("o_orderkey")
    text = plan(frame)
    assert "GreaterThanOrEqual(o_orderdate" in text.replace("`", "")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_time_bound_reads_only_folders_of_its_days(spark, tmp_path):
    rows = [(f"2024-01-0{d} 12:00:00", d) for d in range(1, 8)]
    frame = spark.createDataFrame(rows, "t STRING, d INT").select(F.col("t").cast("timestamp").alias("timestamp"), "d")
    path = str(tmp_path / "rows")
    for batch in (0, 1):
        write_dated_batch(frame, path, batch)
    recent = q.within(spark.read.parquet(path), "2024-01-07 12:00:00", days=1)
    assert sorted(r["d"] for r in recent.collect()) == [6, 6, 7, 7]
    scan = next(line for line in plan(recent).splitlines() if "PartitionFilters" in line)
    assert "event_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_scans_read_only_what_is_used(spark, folder):
    text = plan(q.top_delay_label(buses_view(Tables(spark, folder)), None, None))
    assert "l_extendedprice" not in text and "o_orderpriority" not in text
    assert "p_partkey" not in text


def test_question_four_is_one_aggregation(spark):
    rows = [("2024-01-01", True, "a", 0.5)]
    schema = (
        "timestamp STRING, delay_category_prediction_success BOOLEAN, delay_category_label STRING, "
        "on_time_stop_ratio DOUBLE"
    )
    frame = spark.createDataFrame(rows, schema)
    text = plan(q.top_delay_label(frame, None, None))
    assert text.count("Exchange") == 1
    assert "TakeOrderedAndProject" in text


def test_statistics_aggregate_by_hash_before_the_shuffle(spark):
    frame = spark.createDataFrame([(1, 2)], "trip INT, delay INT")
    text = plan(delay_statistics(frame, ["trip"]))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert "SortAggregate" not in text


def test_split_does_not_shuffle_the_rows(spark):
    frame = spark.range(1000).withColumn("y", F.col("id") % 2).withColumn("wide", F.lit("x") )
    frame = frame.withColumn("wide", F.concat("wide", F.col("id").cast("string")))
    flagged = first_by_hash(frame, "id", ["y"], "1", F.lit(10), "first", few_groups=True)
    exchanges = [line for line in plan(flagged).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("wide" in line for line in exchanges)
    top = plan(flagged).splitlines()[1:4]
    assert any("BroadcastHashJoin" in line for line in top)


@pytest.mark.parametrize("key", ["delay_trend", "nearest_reading", "q9_pair_mean", "q15_spike_corr"])
def test_partition_count_changes_nothing(spark, folder, key):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, entry.queries()[key](spark, folder).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
