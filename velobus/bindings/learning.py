"""Training and scoring operators bound to the given tables."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query, rounded
from velobus.bindings.views import BUSES_SQL, buses_view
from velobus.ml import clusters, features, registry, scoring, supervised
from velobus.schemas import DELAY_CATEGORY_LABELS, UNKNOWN_LABELS


def labelled(t: Tables):
    """Documents with their labels; most are null."""
    return t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars").join(
        t.labels, "doc_id", "left"
    )


LABELLED = """
WITH labelled AS (SELECT doc_id, nullif(lang, 'en') AS lang, n_chars, quality, toxic
                  FROM documents LEFT JOIN labels USING (doc_id))
"""


@query(
    "complete_rows",
    LABELLED
    + "SELECT lang, n_chars, quality FROM labelled WHERE lang IS NOT NULL AND quality IS NOT NULL",
)
def complete_rows(t: Tables):
    return features.complete_rows(labelled(t), ["lang", "n_chars", "quality"])


@query(
    "impute",
    LABELLED
    + """
SELECT doc_id, n_chars * 1.0 AS n_chars,
       coalesce(lang, (SELECT lang FROM labelled WHERE lang IS NOT NULL GROUP BY lang
                       ORDER BY count(*) DESC, lang LIMIT 1)) AS lang,
       round(coalesce(quality, (SELECT avg(quality) FROM labelled)), 6) AS quality,
       round(coalesce(toxic, (SELECT avg(toxic) FROM labelled)), 6) AS toxic
FROM labelled
""",
)
def impute(t: Tables):
    return rounded(features.impute(labelled(t), ["lang", "n_chars", "quality", "toxic"]))


@query(
    "encode",
    "SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code "
    "FROM part",
)
def encode(t: Tables):
    return features.encode(t.part.select("p_partkey", "p_type"), "p_type", "code")


@query(
    "known_category",
    """
SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'PROMO', 'SMALL') THEN p_type ELSE 'LARGE' END AS a,
       CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE 'unknown' END AS b,
       CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS daylight
FROM part
""",
)
def known_category(t: Tables):
    kind = F.col("p_type")
    flag = F.when(F.col("p_size") > 25, "yes").when(F.col("p_size") > 10, "maybe")
    return t.part.select(
        "p_partkey",
        features.known_category(kind, ["LARGE", "PROMO", "SMALL"]).alias("a"),
        features.known_category(kind, ["PROMO", "SMALL", "unknown"]).alias("b"),
        features.known_daylight(flag).alias("daylight"),
    )


@query(
    "scale",
    """
WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d, avg(p_retailprice) AS mp,
                  stddev_pop(p_retailprice) AS dp FROM part)
SELECT p_partkey, round((p_size - m) / d, 6) AS p_size,
       round((p_retailprice - mp) / dp, 6) AS p_retailprice
FROM part, s
""",
)
def scale(t: Tables):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    return rounded(features.standardize(rows, ["p_size", "p_retailprice"]))


@query(
    "bike_targets",
    """
WITH s AS (SELECT p_partkey, CAST(p_partkey % 60 AS INTEGER) AS bikes, p_size - 5 AS capacity FROM part)
SELECT p_partkey, CASE WHEN capacity > 0 AND bikes < 0.25 * capacity THEN 1 ELSE 0 END AS low_bikes,
       CASE WHEN capacity <= 0 OR bikes = 0 THEN 0 WHEN bikes / capacity <= 0.33 THEN 1
            WHEN bikes / capacity <= 0.66 THEN 2 ELSE 3 END AS bike_level,
       CAST(bikes AS DOUBLE) AS bikes_target
FROM s
""",
)
def bike_targets(t: Tables):
    rows = t.part.select(
        "p_partkey",
        (F.col("p_partkey") % 60).cast("int").alias("bikes_available"),
        (F.col("p_size") - 5).alias("capacity"),
    )
    return features.bike_targets(rows).drop("bikes_available", "capacity")


@query(
    "bus_targets",
    "WITH "
    + BUSES_SQL
    + """
SELECT o_orderkey, CASE WHEN average_delay_seconds > 0 THEN 1 ELSE 0 END AS is_late,
       CASE WHEN average_delay_seconds <= 0 THEN 0 WHEN average_delay_seconds <= 300 THEN 1
            ELSE 2 END AS delay_category,
       average_delay_seconds AS delay_target
FROM buses
""",
)
def bus_targets(t: Tables):
    rows = buses_view(t).select("o_orderkey", "average_delay_seconds")
    return features.bus_targets(rows).drop("average_delay_seconds")


@query(
    "strat_split",
    """
SELECT doc_id, quality,
       row_number() OVER (PARTITION BY quality ORDER BY md5('42' || doc_id), doc_id)
       <= ceil(count(*) OVER (PARTITION BY quality) / 5) AS is_test
FROM labels
""",
)
def strat_split(t: Tables):
    return features.split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query(
    "plain_split",
    """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42' || o_orderkey), o_orderkey)
       <= ceil(count(*) OVER () / 5) AS is_test
FROM orders
""",
)
def plain_split(t: Tables):
    return features.split(t.orders.select("o_orderkey"), "o_orderkey")


@query(
    "metrics",
    """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS x, l_returnflag = 'R' AS c,
                  l_quantity > 25 AS d FROM lineitem)
SELECT round(avg(CASE WHEN c = d THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(sqrt(avg((y - x) ** 2)), 4) AS rmse,
       round(1 - sum((y - x) ** 2) / (count(*) * var_pop(y)), 6) AS r2
FROM p
""",
)
def metrics(t: Tables):
    y, x = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    measured = t.lineitem.agg(
        supervised.accuracy(F.col("l_returnflag") == "R", F.col("l_quantity") > 25).alias("accuracy"),
        F.round(supervised.rmse(y, x), 4).alias("rmse"),
        supervised.r_squared(y, x).alias("r2"),
    )
    return rounded(measured)


@query(
    "registry_next",
    """
SELECT 'model-' || c_custkey AS model_name, CAST(coalesce(n, 0) + 1 AS INTEGER) AS version
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""",
)
def registry_next(t: Tables):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    name = F.concat(F.lit("model-"), F.col("o_custkey").cast("string"))
    versions = t.orders.select(name.alias("model_name"), F.row_number().over(order).alias("version"))
    trained = t.customer.select(
        F.concat(F.lit("model-"), F.col("c_custkey").cast("string")).alias("model_name"),
        F.col("c_acctbal").alias("quality_metric"),
        F.lit("").alias("path"),
    )
    return registry.next_versions(versions, trained).select("model_name", "version")


def _vectors(t: Tables):
    return t.embeddings.select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query("kmeans_k")
def kmeans_k(t: Tables):
    best, _, scores = clusters.choose_k(_vectors(t))
    rows = [(k, score, k == best) for k, score in scores]
    return t.spark.createDataFrame(rows, "k INT, silhouette DOUBLE, chosen BOOLEAN")


@query("kmeans_profile")
def kmeans_profile(t: Tables):
    """Centre values per cluster and dimension of a model over all embeddings."""
    model = clusters.fit_kmeans(_vectors(t), 5)
    names = [f"dim_{i}" for i in range(len(model.clusterCenters()[0]))]
    return clusters.cluster_profile(t.embeddings, model, names)


BUS_FEATURES = [
    "stops_count", "fine_particles_pm2_5", "temperature", "precip_mm", "cloud", "visibility_km",
    "humidity", "weather_condition",
]


@query("kmeans_score")
def kmeans_score(t: Tables):
    """Every trip with the cluster a model trained on the complete trips assigns to it."""
    buses = buses_view(t).drop("cluster_id", "cluster_prediction_success")
    rows = features.complete_rows(buses, BUS_FEATURES)
    pipeline, _ = clusters.train_clusters(rows, features.feature_pipeline(rows, BUS_FEATURES))
    scored = scoring.score_cluster(buses, pipeline, BUS_FEATURES)
    return scored.select("o_orderkey", "cluster_id", "cluster_prediction_success")


@query("clf_score")
def clf_score(t: Tables):
    """Every trip with the delay category predicted by the better of two classifiers."""
    rows = features.bus_targets(buses_view(t))
    trained = supervised.train_best(
        rows, BUS_FEATURES, "delay_category", "multiclass", "o_orderkey"
    )
    scored = scoring.score_classes(
        rows, trained.model, BUS_FEATURES, "delay_category", DELAY_CATEGORY_LABELS,
        UNKNOWN_LABELS["delay_category"],
    )
    return scored.select(
        "o_orderkey", "delay_category_prediction", "delay_category_probabilities",
        "delay_category_prediction_success", "delay_category_label",
    )


@query("reg_score")
def reg_score(t: Tables):
    """Every trip with the clipped delay forecast of the better of two regressors."""
    rows = features.bus_targets(buses_view(t))
    trained = supervised.train_best(
        rows, BUS_FEATURES, "delay_target", "regression", "o_orderkey"
    )
    scored = scoring.score_regression(
        rows, trained.model, BUS_FEATURES, "average_delay_seconds"
    )
    return scored.select(
        "o_orderkey", "average_delay_seconds_prediction",
        "average_delay_seconds_prediction_original", "average_delay_seconds_prediction_success",
    )


REGIONS_SQL = """
WITH placed AS (
  SELECT c_custkey, n_regionkey AS region, 1000.0 * n_regionkey + c_custkey % 5 AS x, c_custkey % 5 AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def _regions(t: Tables):
    """Customers as points, far apart between regions and close together within."""
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    key = F.col("c_custkey")
    return t.customer.join(F.broadcast(nations), "c_nationkey").select(
        "c_custkey", F.col("region").cast("int").alias("region"),
        (1000.0 * F.col("region") + key % 5).alias("x"), (key % 5).cast("double").alias("y"),
    )


@query(
    "kmeans_regions",
    REGIONS_SQL + """
SELECT c_custkey, count(*) OVER (PARTITION BY region) AS members, (SELECT count(DISTINCT region) FROM placed)::INT AS k,
       round(avg(x) OVER (PARTITION BY region), 4) AS centre_x, round(avg(y) OVER (PARTITION BY region), 4) AS centre_y
FROM placed
""",
)
def kmeans_regions(t: Tables):
    """The chosen k and every customer's cluster, by its size and centre: the regions are found."""
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=["x", "y"], outputCol="features")
    points = assembler.transform(_regions(t))
    k, _, _, model = clusters.best_fit(points)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    found = model.transform(points).withColumn("centre", F.get(centres, F.col("prediction")))
    # Counted apart and joined, a row per cluster: a window would bring each cluster into one task.
    sizes = found.groupBy("prediction").agg(F.count(F.lit(1)).alias("members"))
    return found.join(F.broadcast(sizes), "prediction").select(
        "c_custkey", "members", F.lit(k).alias("k"),
        F.round(F.col("centre")[0], 4).alias("centre_x"), F.round(F.col("centre")[1], 4).alias("centre_y"),
    )


# Rows the forests of the regions are fitted and tested on, about; all rows are scored.
TRAINED_ON = 500


@query(
    "forest_regions",
    REGIONS_SQL + """
SELECT c_custkey, c_custkey % 11 <> 0 AS ok, CASE WHEN c_custkey % 11 <> 0 THEN region END::INT AS class,
       CASE WHEN c_custkey % 11 <> 0 THEN 'region ' || region END AS label,
       CASE WHEN c_custkey % 11 <> 0 THEN 1.0::DOUBLE END AS total,
       CASE WHEN c_custkey % 11 <> 0 THEN greatest(0.0, 100.0 * region - 50)::DOUBLE END AS forecast,
       CASE WHEN c_custkey % 11 <> 0 THEN (100.0 * region - 50)::DOUBLE END AS original
FROM placed
""",
)
def forest_regions(t: Tables):
    """Classes and forecasts of a full forest, chosen against its rival on the test part, for a label
    and an amount that follow from the region. Every 11th customer lacks a feature at scoring."""
    rows = _regions(t).withColumn("amount", 100.0 * F.col("region") - 50)
    names = ["x", "y"]
    kinds = supervised.train_best(rows, names, "region", "multiclass", "c_custkey", bound=TRAINED_ON)
    amounts = supervised.train_best(rows, names, "amount", "regression", "c_custkey", bound=TRAINED_ON)
    asked = rows.select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("x")).alias("x"), "y")
    scored = scoring.score_classes(asked, kinds.model, names, "region", {i: f"region {i}" for i in range(5)}, "?")
    scored = scoring.score_regression(scored, amounts.model, names, "amount")
    total = F.aggregate("region_probabilities", F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "c_custkey", F.col("region_prediction_success").alias("ok"), F.col("region_prediction").alias("class"),
        F.col("region_label").alias("label"), F.round(total, 6).alias("total"),
        F.round("amount_prediction", 4).alias("forecast"), F.round("amount_prediction_original", 4).alias("original"),
    )


@query(
    "zero_fill",
    REGIONS_SQL + "SELECT c_custkey, region::INT AS class, false AS plain FROM placed",
)
def zero_fill(t: Tables):
    """Every customer's class where a column of the trained model is not there: 0 stands in for it
    if that is asked for, else there is no prediction."""
    rows, names = _regions(t), ["x", "y"]
    trained = supervised.train_best(rows, names, "region", "multiclass", "c_custkey", bound=TRAINED_ON)
    labels = {i: f"region {i}" for i in range(5)}
    asked = rows.select("c_custkey", "x")
    filled = scoring.score_classes(asked, trained.model, names, "region", labels, "?", zero_fill=True)
    plain = scoring.score_classes(asked, trained.model, names, "plain", labels, "?")
    both = filled.select("c_custkey", F.col("region_prediction").alias("class"))
    return both.join(plain.select("c_custkey", F.col("plain_prediction_success").alias("plain")), "c_custkey")


@query(
    "linear_fit",
    """
WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                    regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
SELECT round(b, 4) AS slope, round(a, 3) AS intercept, round(r2, 6) AS r2,
       round((SELECT sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)) FROM lineitem, fit), 3) AS rmse
FROM fit
""",
)
def linear_fit(t: Tables):
    """The linear candidate over one feature, and its metrics over the rows it was fitted on."""
    from pyspark.ml.feature import VectorAssembler

    rows = t.lineitem.select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    points = VectorAssembler(inputCols=["q"], outputCol="features").transform(rows)
    model = supervised.candidates("regression", "price", 0)["LinearRegression"].fit(points)
    measured = supervised.evaluate(model, "regression", "price", points)
    values = (round(float(model.coefficients[0]), 4), round(model.intercept, 3), round(measured["r2"], 6), round(measured["rmse"], 3))
    return t.spark.createDataFrame([values], "slope DOUBLE, intercept DOUBLE, r2 DOUBLE, rmse DOUBLE")
