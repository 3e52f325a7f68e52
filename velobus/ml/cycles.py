"""Training cycles: stored rows to staged models in the registry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.ml import clusters, supervised
from velobus.ml.features import (
    bike_targets,
    bus_targets,
    complete_rows,
    feature_pipeline,
    impute,
    known_daylight,
)
from velobus.ml.registry import Registry
from velobus.schemas import (
    CLASS_BIKE_FEATURES,
    CLASS_BUS_FEATURES,
    CLUSTER_BIKE_FEATURES,
    CLUSTER_BUS_FEATURES,
    TRAINING_WINDOW_DAYS,
)
from velobus.session import stored_copy, wide_records
from velobus.sources.tables import AsOf, class_training_scan, cluster_training_scan, training_scan

CLUSTER_MODELS = {
    "bikes": ("bikes_kmeans", CLUSTER_BIKE_FEATURES),
    "buses": ("buses_kmeans", CLUSTER_BUS_FEATURES),
}

# Per sector: features, targets, row key, and (registry name, kind, label) of the three models.
CLASS_MODELS = {
    "bikes": (
        CLASS_BIKE_FEATURES,
        bike_targets,
        ["station_id", "timestamp"],
        [
            ("bikes_binary_classifier", "binary", "low_bikes"),
            ("bikes_multiclass_classifier", "multiclass", "bike_level"),
            ("bikes_regression_predictor", "regression", "bikes_target"),
        ],
    ),
    "buses": (
        CLASS_BUS_FEATURES,
        bus_targets,
        ["vehicle_id", "trip_identifier", "timestamp"],
        [
            ("bus_binary_classifier", "binary", "is_late"),
            ("bus_multiclass_classifier", "multiclass", "delay_category"),
            ("bus_regression_predictor", "regression", "delay_target"),
        ],
    ),
}


def cluster_cycle(
    table: DataFrame,
    sector: str,
    registry: Registry,
    as_of: AsOf = None,
    ks=clusters.K_RANGE,
    restarts: int = clusters.RESTARTS,
) -> float:
    """Train the sector's k-means on the recent complete rows, publish it, return its quality."""
    name, features = CLUSTER_MODELS[sector]
    rows = complete_rows(cluster_training_scan(table, sector, as_of), features)
    if rows.isEmpty():
        raise ValueError(f"no complete rows to train {name}")
    with wide_records(table.sparkSession):
        preparation = feature_pipeline(rows, features)
        model, quality = clusters.train_clusters(rows, preparation, ks, restarts)
    registry.publish(name, model, quality)
    return quality


def row_key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def class_rows(table: DataFrame, sector: str, as_of: AsOf = None) -> tuple[DataFrame, list[str]]:
    """(rows with imputed features, targets and a row key; the features the table has)."""
    wanted, targets, keys, _ = CLASS_MODELS[sector]
    columns = class_training_scan(table, sector, as_of).columns
    features = [c for c in wanted if c in columns]
    days = TRAINING_WINDOW_DAYS[f"class_{sector}"]
    rows = training_scan(table, [*columns, *keys], days, as_of)
    rows = rows.withColumn("row_key", row_key(keys)).select("row_key", *columns)
    flags = [c for c, t in rows.dtypes if t == "boolean"]
    rows = impute(rows.withColumns({c: F.col(c).cast("double") for c in flags}), columns)
    if "daylight" in columns:
        rows = rows.withColumn("daylight", known_daylight(F.col("daylight")))
    return targets(rows), features


def class_cycle(
    table: DataFrame,
    sector: str,
    registry: Registry,
    as_of: AsOf = None,
    trees: int = supervised.TREES,
    depth: int = supervised.MAX_DEPTH,
    cross_validate: bool = False,
) -> dict[str, supervised.Trained]:
    """Train the sector's three models and publish those that could be trained."""
    results = {}
    with wide_records(table.sparkSession):
        rows, features = class_rows(table, sector, as_of)
        # Three models, and several passes for each, read these rows.
        rows = stored_copy(rows, "training")
        for name, kind, label in CLASS_MODELS[sector][3]:
            trained = supervised.train_best(
                rows, features, label, kind, "row_key", trees, depth, cross_validate
            )
            if trained.model is not None:
                registry.publish(name, trained.model, trained.quality)
            results[name] = trained
    return results
