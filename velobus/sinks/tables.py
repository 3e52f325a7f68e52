"""Sinks: topics, tables written once per micro-batch, documents, evaluation records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_values(messages: DataFrame) -> DataFrame:
    """One JSON value per message, for a topic or a JSON-lines file."""
    return messages.select(F.to_json(F.struct("*")).alias("value"))


def publish_kafka(messages: DataFrame, topic: str, servers: str) -> None:
    writer = to_values(messages).write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_files(messages: DataFrame, path: str) -> None:
    to_values(messages).write.mode("append").text(path)


def write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder; a retry of the batch replaces it whole."""
    frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_dated_batch(frame: DataFrame, path: str, batch_id: int, time: str = "timestamp") -> None:
    """The same, split by event date below the batch folder for partition pruning."""
    dated = frame.withColumn("event_date", F.to_date(time))
    dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}")


def write_plain(frame: DataFrame, folder: str) -> None:
    """Write a folder that does not exist yet; commits.py makes it count."""
    frame.write.parquet(folder)


def write_dated(frame: DataFrame, folder: str, time: str = "timestamp") -> None:
    """The same, split by event date for partition pruning."""
    frame.withColumn("event_date", F.to_date(time)).write.partitionBy("event_date").parquet(folder)


def write_json(frame: DataFrame, folder: str) -> None:
    frame.write.json(folder)


def read_batches(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents(frame: DataFrame, sentence: str, metadata: Column, workspace: str) -> DataFrame:
    """Document feed rows: text, workspace, metadata map."""
    return frame.select(
        F.col(sentence).alias("text"),
        F.lit(workspace).alias("workspace"),
        metadata.alias("metadata"),
    )


def with_title(metadata: Column, title: Column) -> Column:
    """The metadata with a title added when it has none."""
    absent = ~F.map_contains_key(metadata, F.lit("title"))
    return F.when(absent, F.map_concat(F.create_map(F.lit("title"), title), metadata)).otherwise(
        metadata
    )


def write_document_batch(feed: DataFrame, path: str, batch_id: int) -> None:
    feed.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def write_snapshot(frame: DataFrame, path: str, version: int) -> None:
    """A table state as an immutable version folder; readers take the highest."""
    frame.write.mode("overwrite").parquet(f"{path}/version={version}")
