"""K-means: choice of k, training with restarts, scoring, cluster profile."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from velobus.ml.features import SEED, packed
from velobus.ml.restarts import fit_all

K_RANGE = range(2, 9)
RESTARTS = 10
PARALLEL_SCORES = 4
ROWS_PER_TASK = 5_000  # each is compared with the centres of all runs


def _model(spark: SparkSession, centres: np.ndarray, seed: int) -> KMeansModel:
    """Spark's model with these centres: drawn without further rounds from a frame that holds just them."""
    rows = pa.table({"v": np.unique(centres, axis=0).tolist()})  # from Arrow: no Python worker reads it
    points = spark.createDataFrame(rows).coalesce(1).select(array_to_vector("v").alias("features"))
    return KMeans(k=max(2, len(centres)), seed=seed, initMode="random", maxIter=0, featuresCol="features").fit(points)


def _dealt(vectors: DataFrame) -> DataFrame:
    most = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    return packed(vectors.select("features"), ROWS_PER_TASK, most)


def fit_kmeans(
    vectors: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED
) -> KMeansModel:
    """The restart with the lowest inertia; the first of equals."""
    centres = fit_all(_dealt(vectors), [k], restarts, seed)[k]
    return _model(vectors.sparkSession, centres, seed)


def silhouette(model: KMeansModel, vectors: DataFrame) -> float:
    """Mean silhouette; -1 when fewer than two clusters are in use."""
    scored = model.transform(vectors)
    if scored.select("prediction").distinct().count() < 2:
        return -1.0
    return ClusteringEvaluator(featuresCol="features").evaluate(scored)


def choose_k(
    vectors: DataFrame, ks=K_RANGE, restarts: int = RESTARTS, seed: int = SEED
) -> tuple[int, float, list[tuple[int, float]]]:
    """(best k, its silhouette, all scores). First best wins; nothing valid gives (2, 0.0)."""
    return best_fit(vectors, ks, restarts, seed)[:3]


def best_fit(
    vectors: DataFrame, ks=K_RANGE, restarts: int = RESTARTS, seed: int = SEED
) -> tuple[int, float, list[tuple[int, float]], KMeansModel | None]:
    """What choose_k() gives, and the model of the best k (None if nothing is valid).

    The vectors are read once and kept; every fit and every score runs on the kept copy. All runs
    of all k share their passes over it.
    """
    kept = _dealt(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        if rows < 2:
            return 2, 0.0, [], None
        fitting = [k for k in ks if k < rows]
        centres = fit_all(kept, fitting, restarts, seed) if fitting else {}
        models = {k: _model(kept.sparkSession, c, seed) for k, c in centres.items()}
        with ThreadPool(PARALLEL_SCORES) as pool:
            found = dict(zip(fitting, pool.map(lambda k: silhouette(models[k], kept), fitting)))
        scores = [(k, found.get(k, -1.0)) for k in ks]
    finally:
        kept.unpersist()
    best_k, best = max(scores, key=lambda s: (s[1], -s[0]))
    return (2, 0.0, scores, None) if best == -1.0 else (best_k, best, scores, models[best_k])


def train_clusters(
    prepared: DataFrame, preparation: PipelineModel, ks=K_RANGE, restarts: int = RESTARTS
) -> tuple[PipelineModel, float]:
    """Pipeline of preparation and k-means for the best k, and its silhouette."""
    vectors = preparation.transform(prepared).select("features")
    k, quality, _, model = best_fit(vectors, ks, restarts)
    if model is None:
        model = fit_kmeans(vectors, k, restarts)
        quality = silhouette(model, vectors)
    quality = max(quality, 0.0)
    return PipelineModel(stages=[*preparation.stages, model]), quality


def cluster_profile(frame: DataFrame, model: KMeansModel, names: list[str]) -> DataFrame:
    """(cluster_id, feature, centre) of a model: k times features rows, in scaled space."""
    rows = [
        (i, name, float(value))
        for i, centre in enumerate(model.clusterCenters())
        for name, value in zip(names, centre)
    ]
    return frame.sparkSession.createDataFrame(rows, "cluster_id INT, feature STRING, centre DOUBLE")
