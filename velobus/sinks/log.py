"""The log table: (service, level, event, n, created_at) rows from jobs and from running streams."""

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger(__name__)
LOG_TABLE = "service STRING, level STRING, event STRING, n BIGINT, created_at TIMESTAMP"


def log_rows(spark: SparkSession, events: Iterable[tuple[str, str, str, int]]) -> DataFrame:
    rows = spark.createDataFrame(list(events), "service STRING, level STRING, event STRING, n BIGINT")
    return rows.withColumn("created_at", F.current_timestamp())


def write_log(spark: SparkSession, events: Iterable[tuple[str, str, str, int]], path: str) -> None:
    """Append log rows; a row counts how often its event happened."""
    log_rows(spark, events).coalesce(1).write.mode("append").parquet(path)


class StreamLog(StreamingQueryListener):
    """Writes a row for every batch of every stream, with its input rows, and one when a stream ends.

    Listeners see a stream from outside, so they also log batches that failed before their commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, service: str, level: str, event: str, n: int) -> None:
        try:
            write_log(self.spark, [(service, level, event, n)], self.path)
        except Exception as error:  # a log that fails must not end the stream
            LOG.warning("log row lost: %s", error)

    def onQueryStarted(self, event) -> None:
        self._write(event.name or str(event.id), "INFO", "started", 1)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._write(progress.name or str(progress.id), "INFO", "batch", progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self._write(str(event.id), "ERROR" if failed else "INFO", "failed" if failed else "ended", 1)
