"""Training: targets, split, choice of k, selection, scoring."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from velobus.ml import clusters, features, scoring, supervised
from velobus.schemas import DELAY_CATEGORY_LABELS

LABELS = (DELAY_CATEGORY_LABELS, "nieznana_kategoria")


def test_bike_targets(spark):
    cases = [(20, 0, 1, 0), (20, 4, 1, 1), (20, 5, 0, 1), (100, 33, 0, 1), (20, 10, 0, 2),
             (20, 14, 0, 3), (0, 3, 0, 0)]
    frame = spark.createDataFrame(cases, "capacity INT, bikes_available INT, low INT, level INT")
    for r in features.bike_targets(frame).collect():
        assert (r["low_bikes"], r["bike_level"]) == (r["low"], r["level"])


def test_bus_targets(spark):
    cases = [(-5.0, 0, 0), (0.0, 0, 0), (0.5, 1, 1), (300.0, 1, 1), (300.01, 1, 2)]
    frame = spark.createDataFrame(cases, "average_delay_seconds DOUBLE, late INT, cat INT")
    for r in features.bus_targets(frame).collect():
        assert (r["is_late"], r["delay_category"]) == (r["late"], r["cat"])


def test_impute_all_null_columns(spark):
    frame = spark.createDataFrame(
        [(1.0, None, None, "b"), (3.0, None, None, "a"), (None, None, None, "a"), (None, None, None, None)],
        "x DOUBLE, y INT, s STRING, t STRING",
    )
    rows = features.impute(frame, ["x", "y", "s", "t"]).collect()
    assert sorted(tuple(r) for r in rows) == [
        (1.0, 0.0, "unknown", "b"), (2.0, 0.0, "unknown", "a"), (2.0, 0.0, "unknown", "a"),
        (3.0, 0.0, "unknown", "a"),
    ]


def test_missing_feature_column_is_an_error(spark):
    with pytest.raises(ValueError):
        features.complete_rows(spark.range(1), ["nope"])


def test_split_is_stratified_and_repeatable(spark):
    frame = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    marked = features.split(frame, "id", "y")
    sizes = {(r["y"], r["is_test"]): r["count"] for r in marked.groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = features.split(frame.repartition(7), "id", "y").where("is_test")
    assert {r["id"] for r in again.collect()} == {
        r["id"] for r in marked.where("is_test").collect()
    }


def blobs(spark, centres, each=30):
    rng = random.Random(0)
    rows = [([x + rng.gauss(0, 0.1), y + rng.gauss(0, 0.1)],) for x, y in centres for _ in range(each)]
    return spark.createDataFrame(rows, "v ARRAY<DOUBLE>").select(array_to_vector("v").alias("features"))


def test_choose_k(spark):
    vectors = blobs(spark, [(0, 0), (10, 0), (0, 10)])
    best, score, scores = clusters.choose_k(vectors, range(2, 6), restarts=2)
    assert best == 3
    assert score == max(s for _, s in scores)
    assert all(-1 <= s <= 1 for _, s in scores)
    assert clusters.choose_k(vectors.limit(1))[:2] == (2, 0.0)


def test_runs_share_their_passes(spark, monkeypatch):
    """A round is one pass for all restarts of all k; every centre ends as the mean of its rows."""
    from velobus.ml import restarts

    rounds, assign = [], restarts._assign
    monkeypatch.setattr(restarts, "_assign", lambda d, o, runs: rounds.append(len(runs)) or assign(d, o, runs))
    rng = np.random.default_rng(2)
    rows = rng.normal(1e6, 1, (500, 3))
    frame = spark.createDataFrame([(r.tolist(),) for r in rows], "v ARRAY<DOUBLE>").repartition(5)
    found = restarts.fit_all(frame.select(array_to_vector("v").alias("features")), [2, 3, 5], 4, 1)
    assert rounds[0] == 12 and rounds == sorted(rounds, reverse=True) and len(rounds) <= restarts.ROUNDS
    for k, centres in found.items():
        assert centres.shape == (k, 3)
        near = ((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([rows[near == c].mean(axis=0) for c in range(k)])
        assert np.abs(means - centres).max() < 1e-3
    assert max(rounds) < sum(rounds) and restarts.fit_all(frame.select(array_to_vector("v").alias("features")), [3], 4, 1)[3].tolist() == found[3].tolist()


def test_fewer_distinct_vectors_than_centres(spark):
    frame = spark.createDataFrame([([1.0, 2.0],)] * 6 + [([3.0, 4.0],)] * 3, "v ARRAY<DOUBLE>")
    vectors = frame.select(array_to_vector("v").alias("features"))
    model = clusters.fit_kmeans(vectors, 4, restarts=2)
    assert np.sort(model.clusterCenters(), axis=0) == pytest.approx(np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert {r["features"][0]: r["n"] for r in model.transform(vectors).groupBy("features", "prediction").agg(F.count("*").alias("n")).collect()} == {1.0: 6, 3.0: 3}
    best, score, _ = clusters.choose_k(vectors, range(2, 4), restarts=2)
    assert (best, score) == (2, pytest.approx(1.0))
    assert clusters.choose_k(vectors.limit(3))[:2] == (2, 0.0)
    with pytest.raises(ValueError):
        clusters.fit_kmeans(vectors.limit(0), 2)


def test_a_learners_few_tasks_do_not_read_the_tables(spark):
    """What few tasks hold comes to them by a shuffle; the joins before it stay spread."""
    joined = spark.range(400).repartition(40).withColumn("at", F.spark_partition_id())
    kept = features.packed(joined)
    assert kept.rdd.getNumPartitions() == 1 and kept.count() == 400
    assert kept.select("at").distinct().count() == 40
    assert features.packed(joined, rows=10).rdd.getNumPartitions() == 40
    assert features.packed(joined, rows=10, most=6).rdd.getNumPartitions() == 6
    assert features.packed(joined, rows=1, most=6).rdd.getNumPartitions() == 20
    assert kept.collect() == features.packed(joined).collect()


def test_a_large_cluster_stays_spread(spark, tmp_path):
    """Nine customers of ten in one region: its size is known to all of them, no task holds them."""
    from velobus.bindings.learning import kmeans_regions
    from velobus.bindings.registry import Tables

    region = F.when(F.col("id") % 10 == 0, F.floor(F.col("id") / 10) % 4 + 1).otherwise(0)
    customers = spark.range(2000).select(F.col("id").alias("c_custkey"), region.cast("int").alias("c_nationkey"))
    customers.repartition(6).write.parquet(f"{tmp_path}/customer.parquet")
    nations = spark.range(5).select(F.col("id").cast("int").alias("n_nationkey"), F.col("id").cast("int").alias("n_regionkey"))
    nations.write.parquet(f"{tmp_path}/nation.parquet")
    rows = kmeans_regions(Tables(spark, str(tmp_path))).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["c_custkey"] for r in rows}) == len(rows) == 2000
    sizes = {round(r["centre_x"] / 1000): r["members"] for r in rows}
    assert sizes == {0: 1800, 1: 50, 2: 50, 3: 50, 4: 50} and {r["k"] for r in rows} == {5}
    tasks = [r["task"] for r in rows if r["members"] == 1800]
    assert len(set(tasks)) > 2 and max(map(tasks.count, set(tasks))) < 900


def test_cluster_profile(spark):
    model = clusters.fit_kmeans(blobs(spark, [(0, 0), (10, 0)]), 2, restarts=1)
    rows = clusters.cluster_profile(spark.range(1), model, ["a", "b"]).collect()
    assert {(r["cluster_id"], r["feature"]) for r in rows} == {(0, "a"), (0, "b"), (1, "a"), (1, "b")}


def trips(spark, n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = rng.uniform(-1, 1)
        weather = rng.choice(["Sun", "Rain"])
        rows.append((i, x, weather, 600.0 * x, 0 if x <= 0 else (1 if x <= 0.5 else 2)))
    return spark.createDataFrame(rows, "id INT, x DOUBLE, weather STRING, delay DOUBLE, cat INT")


def test_classifier_beats_the_majority_and_scores(spark):
    frame = trips(spark)
    trained = supervised.train_best(frame, ["x", "weather"], "cat", "multiclass", "id", trees=5, depth=4)
    assert trained.quality > 0.6 and trained.name
    new = spark.createDataFrame(
        [(1, -0.9, "Snow"), (2, 0.9, "Rain"), (3, None, "Rain"), (4, 0.9, None)],
        "id INT, x DOUBLE, weather STRING",
    )
    scored = scoring.score_classes(new, trained.model, ["x", "weather"], "p", *LABELS).orderBy("id")
    assert scored.columns[:3] == ["id", "x", "weather"]
    rows = scored.collect()
    assert [r["p_prediction"] for r in rows] == [0, 2, None, None]
    assert [r["p_label"] for r in rows] == ["na czas", "bardzo spóźniony", None, None]
    assert [r["p_prediction_success"] for r in rows] == [True, True, False, False]
    assert rows[0]["weather"] == "Snow" and rows[2]["x"] is None
    assert sum(rows[0]["p_probabilities"]) == pytest.approx(1)
    assert len(rows[1]["p_probabilities"]) == 3


def test_one_vs_rest_scores_have_probabilities(spark):
    frame = trips(spark)
    ready = features.feature_pipeline(frame, ["x"])
    label = F.col("cat").cast("double")
    estimator = supervised.candidates("multiclass", "y", 300)["LogisticRegression"]
    model = estimator.fit(ready.transform(frame).withColumn("y", label))
    pipeline = type(ready)(stages=[*ready.stages, model])
    rows = scoring.score_classes(frame, pipeline, ["x"], "p", *LABELS).collect()
    assert all(len(r["p_probabilities"]) == 3 for r in rows)
    assert all(abs(sum(r["p_probabilities"]) - 1) < 1e-9 for r in rows)


def test_regression(spark):
    trained = supervised.train_best(trips(spark), ["x"], "delay", "regression", "id", trees=5, depth=4)
    assert trained.name == "LinearRegression"
    assert trained.metrics["r2"] > 0.99
    new = spark.createDataFrame([(1, -0.5), (2, 0.5), (3, None)], "id INT, x DOUBLE")
    rows = scoring.score_regression(new, trained.model, ["x"], "d").orderBy("id").collect()
    assert rows[0]["d_prediction"] == 0.0 and rows[0]["d_prediction_original"] < -200
    assert rows[1]["d_prediction"] == rows[1]["d_prediction_original"] > 200
    assert (rows[2]["d_prediction"], rows[2]["d_prediction_success"]) == (None, False)


def test_too_little_data_trains_nothing(spark):
    assert supervised.train_best(trips(spark, 1), ["x"], "cat", "multiclass", "id").model is None
    one_class = trips(spark, 20).withColumn("cat", F.lit(1))
    assert supervised.train_best(one_class, ["x"], "cat", "binary", "id").quality == 0.0


def test_selection_prefers_the_first_of_equals():
    assert supervised.select_best([("a", 0.5), ("b", 0.5)], "binary") == "a"
    assert supervised.select_best([("a", 2.0), ("b", 1.0)], "regression") == "b"
    assert supervised.select_best([], "binary") is None


def test_scoring_without_model(spark):
    row = scoring.score_cluster(spark.range(1), None, ["x"]).first()
    assert (row["cluster_id"], row["cluster_prediction_success"]) == (None, False)


def test_cross_validation_runs(spark):
    frame = trips(spark, 120).withColumn("y", (F.col("delay") > 0).cast("double"))
    ready = features.feature_pipeline(frame, ["x"]).transform(frame)
    estimator = supervised.candidates("binary", "y", 120)["LogisticRegression"]
    assert 0.5 < supervised.cross_validated(estimator, "binary", "y", ready) <= 1


def test_encode_in_slices(spark):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["sharedprefix1", "sharedprefix2", None]
    frame = spark.createDataFrame([(w,) for w in words * 2], "w STRING").repartition(4)
    order = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    want = {w: i for i, w in enumerate(order)} | {None: None}
    for slices in (None, 2, 40):
        coded = features.encode(frame, "w", "code", slices)
        assert {r["w"]: r["code"] for r in coded.collect()} == want
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(_word" not in plan
    assert features.encode(frame.limit(0), "w", "code").count() == 0
