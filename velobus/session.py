"""Session settings the jobs rely on, and the shared work folder."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings, all changeable at run time. Skewed join partitions are split even when that costs
# one more exchange: a hot trip, station or hour must not end up in one task.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Small shuffle partitions are packed into tasks of this many bytes at most. The bytes are compressed:
# a task that joins, aggregates and sorts line items holds some 25 times as many in memory.
PACKED_BYTES = 16 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session; a smaller size of tasks is left as it is."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(ADVISORY)) > PACKED_BYTES:
        spark.conf.set(ADVISORY, f"{PACKED_BYTES}b")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("velobus")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for this run, below the shared folder named in spark.checkpoint.dir.

    Executors on other machines must see it, so a machine-local folder is only accepted when the
    session itself is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="velobus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored_copy(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame that several jobs read to the shared folder, and read it from there.

    Unlike a cached frame it survives the loss of executors, and its readers fetch only the
    columns they need.
    """
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def wide_records(spark: SparkSession):
    """For plans that rework dozens of columns in many steps: the planner would spend minutes
    deriving null constraints through every alias, and these plans gain nothing from them."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession, low: int = 8) -> int:
    """How many slices to cut ordered data into: one per shuffle partition, ``low`` at least."""
    return max(low, int(spark.conf.get("spark.sql.shuffle.partitions")))
