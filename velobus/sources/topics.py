"""Topic messages: JSON values from Kafka, or from files where no broker is at hand."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.schemas import MESSAGE_SCHEMAS


def kafka_topic(
    spark: SparkSession,
    topic: str,
    servers: str,
    max_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Raw values of a topic, from the earliest offset on the first run."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_topic(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Raw values of JSON-lines files as a stream."""
    reader = spark.readStream.schema("value STRING")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def parse(values: DataFrame, topic: str) -> DataFrame:
    """Typed messages next to their raw text; ``bad`` marks text that is no such message."""
    schema = f"{MESSAGE_SCHEMAS[topic]}, _corrupt STRING"
    message = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = values.select("value", message.alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    return parsed.select("value", F.coalesce(bad, F.lit(True)).alias("bad"), "m.*").drop("_corrupt")


def messages(values: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(typed messages, raw text that could not be parsed)."""
    parsed = parse(values, topic)
    return parsed.where(~F.col("bad")).drop("value", "bad"), parsed.where("bad").select("value")
