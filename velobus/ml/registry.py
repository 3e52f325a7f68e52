"""Append-only model registry: immutable version folders, current = latest version per name.

A trainer appends a version flagged as new. The consumer promotes the newest staged version at
start-up or between batches by appending the same version without the flag. Nothing is renamed or
updated in place, so a reader never meets a half-swapped model.
"""

import logging
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from velobus.operators.feeds import latest_per_key
from velobus.schemas import MODEL_NAMES, REGISTRY_TABLE
from velobus.sinks.commits import create_once

LOG = logging.getLogger(__name__)
COLUMNS = ["version", "quality_metric", "path", "is_new_model_available", "last_updated"]


def current(versions: DataFrame) -> DataFrame:
    """The latest registry row per model: highest version, then the latest entry of it."""
    return latest_per_key(versions, ["model_name"], ["version", "last_updated"], COLUMNS)


def next_versions(versions: DataFrame, trained: DataFrame) -> DataFrame:
    """Registry rows for newly trained models (model_name, quality_metric, path): version + 1,
    or 1 for a name not seen before."""
    known = versions.groupBy(F.col("model_name").alias("_name")).agg(
        F.max("version").alias("_version")
    )
    joined = trained.join(known, F.col("model_name") == F.col("_name"), "left")
    return joined.select(
        "model_name",
        (F.coalesce("_version", F.lit(0)) + 1).cast("int").alias("version"),
        "quality_metric",
        "path",
        F.lit(True).alias("is_new_model_available"),
        F.current_timestamp().alias("last_updated"),
    )


class Registry:
    """The registry table and the model folders below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.table = f"{self.root}/registry"

    def versions(self) -> DataFrame:
        """The registry's rows; only a registry that was never written counts as empty."""
        try:
            return self.spark.read.schema(REGISTRY_TABLE).parquet(self.table)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], REGISTRY_TABLE)

    def seed(self) -> None:
        """Version 1 of every model without artefact; names already present are left alone."""
        names = self.spark.createDataFrame([(n,) for n in MODEL_NAMES], "model_name STRING")
        missing = names.join(self.versions(), "model_name", "left_anti").select(
            "model_name",
            F.lit(1).alias("version"),
            F.lit(0.0).alias("quality_metric"),
            F.lit(None).cast("string").alias("path"),
            F.lit(False).alias("is_new_model_available"),
            F.current_timestamp().alias("last_updated"),
        )
        missing.coalesce(1).write.mode("append").parquet(self.table)

    def status(self) -> DataFrame:
        """One row per model: version, quality, path, whether a staged version waits."""
        return current(self.versions())

    def _entry(self, name: str):
        return self.status().where(F.col("model_name") == name).first()

    def publish(self, name: str, model: PipelineModel, quality: float) -> int:
        """Save the model as a new staged version and append its registry row.

        Every attempt has a folder of its own, so nothing a reader may hold is ever overwritten. The
        version is claimed by creating a file: of two trainers at once, the second gets the next.
        """
        path = f"{self.root}/models/{name}/{uuid.uuid4().hex}"
        model.write().save(path)
        trained = self.spark.createDataFrame([(name, float(quality), path)],
                                             "model_name STRING, quality_metric DOUBLE, path STRING")
        rows = next_versions(self.versions(), trained)
        version = rows.first()["version"]
        while not create_once(self.spark, f"{self.root}/claims/{name}/{version}", path):
            version += 1
        claimed = rows.withColumn("version", F.lit(version))
        claimed.coalesce(1).write.mode("append").parquet(self.table)
        return version

    def promote(self, name: str) -> None:
        """Append the staged version without the flag; without a staged version do nothing."""
        staged = self.status().where((F.col("model_name") == name) & F.col("is_new_model_available"))
        row = staged.first()
        if row is None:
            return
        entry = self.spark.createDataFrame(
            [(name, row["version"], row["quality_metric"], row["path"], False)],
            "model_name STRING, version INT, quality_metric DOUBLE, path STRING, "
            "is_new_model_available BOOLEAN",
        ).withColumn("last_updated", F.current_timestamp())
        entry.coalesce(1).write.mode("append").parquet(self.table)


class ModelCache:
    """Models of the consumer, loaded once per version; refreshed once per micro-batch."""

    def __init__(self, registry: Registry):
        self.registry = registry
        self.loaded: dict[str, tuple[str, PipelineModel]] = {}
        self.failed: dict[str, str] = {}  # models whose current version could not be loaded

    def refresh(self) -> dict[str, PipelineModel]:
        """All current models. A version that cannot be loaded leaves the former one in use."""
        for row in self.registry.status().collect():
            name, path = row["model_name"], row["path"]
            if path is None or self.loaded.get(name, (None,))[0] == path:
                continue
            try:
                self.loaded[name] = (path, PipelineModel.load(path))
            except Exception as error:  # whatever is wrong with one model, the others go on
                LOG.warning("model %s, version %s not loaded: %s", name, row["version"], error)
                self.failed[name] = path
                continue
            self.failed.pop(name, None)
            if row["is_new_model_available"]:
                self.registry.promote(name)
        return {name: model for name, (_, model) in self.loaded.items()}
