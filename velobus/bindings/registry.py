"""Registered queries: each key has a Spark callable and, where SQL can say it, an oracle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables, read on demand: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(key: str, sql: str | None = None):
    """Register ``build(t)`` under a key, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Floating results rounded, so that the order of summation does not show."""
    return frame.select(
        *[
            F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in frame.dtypes
        ]
    )
