"""Producer jobs: landed feed documents to topic messages, with counts of what was sent and not."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velobus.operators import feeds
from velobus.sinks.log import write_log
from velobus.sources import feeds as documents

Sink = Callable[[DataFrame], None]
MAX_BYTES = 1_000_000  # what a broker accepts by default, about
POLL = ("poll",)


def station_messages(
    spark: SparkSession,
    info_path: str,
    status_path: str,
    prefix: str | None,
    ingest_ts: Column | None = None,
) -> DataFrame:
    """Stations of every poll with the name prefix, ordered by name as the topic expects them."""
    info, status = (documents.read_documents(spark, path) for path in (info_path, status_path))
    return stations_of(info, status, prefix, ingest_ts).orderBy("name")


def stations_of(
    info: DataFrame,
    status: DataFrame,
    prefix: str | None,
    ingest_ts: Column | None = None,
    exact: bool = False,
) -> DataFrame:
    """The same from documents that are at hand, in any order; with ``exact`` a name or capacity that
    is null in its document stays null, and only one that is not there gets its default."""
    stations = (documents.exact_station_info if exact else documents.station_info)(info)
    states, place = documents.station_status(status), F.col("ord")
    return feeds.merge_stations(stations.drop("ord"), states, place, prefix, ingest_ts, POLL, exact)


def bus_messages(
    spark: SparkSession,
    positions_path: str,
    departures_path: str,
    ingest_ts: Column | None = None,
) -> DataFrame:
    """One message per poll, vehicle and trip with its stops in feed order."""
    paths = (positions_path, departures_path)
    return trips_of(*(documents.read_documents(spark, path) for path in paths), ingest_ts)


def trips_of(
    positions: DataFrame, departures: DataFrame, ingest_ts: Column | None = None
) -> DataFrame:
    """The same from documents that are at hand."""
    positions = documents.vehicle_positions(positions).withColumnRenamed("ord", "seen")
    departures = documents.departures(departures)
    located = feeds.attach_positions(departures, positions, F.col("seen"), POLL)
    return feeds.trip_messages(located, ingest_ts, POLL)


def environment_messages(
    spark: SparkSession, path: str, city: str, ingest_ts: Column | None = None
) -> DataFrame:
    weather = documents.weather(documents.read_documents(spark, path))
    return feeds.weather_message(weather, city, ingest_ts)


@dataclass(frozen=True)
class Published:
    """How many messages a job had, sent and set aside."""

    total: int
    sent: int
    failed: int

    def log(self, service: str) -> list[tuple[str, str, str, int]]:
        """Rows for the log table."""
        counts = (("INFO", "total", self.total), ("INFO", "sent", self.sent), ("ERROR", "failed", self.failed))
        return [(service, level, event, n) for level, event, n in counts]


def publish(
    messages: DataFrame,
    sink: Sink,
    aside: Sink | None = None,
    required: Sequence[str] = (),
    max_bytes: int = MAX_BYTES,
) -> Published:
    """Send what can be sent, and hand the other messages to ``aside``; the feeds are read once.

    A message without one of the ``required`` fields, or longer as JSON than a topic accepts, can't
    be sent. It never keeps the others from going out. A sink that fails as a whole raises.
    """
    whole = F.struct("*")
    lacking = reduce(lambda a, c: a | F.col(c).isNull(), required, F.lit(False))
    marked = messages.withColumn("_bad", lacking | (F.octet_length(F.to_json(whole)) > max_bytes))
    kept = marked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sink(kept.where(~F.col("_bad")).drop("_bad"))
        if aside is not None:
            aside(kept.where("_bad").drop("_bad"))
        row = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("bad")).first()
        return Published(row["n"], row["n"] - row["bad"], row["bad"])
    finally:
        kept.unpersist()


def environment_producer(
    spark: SparkSession,
    path: str,
    city: str,
    sink: Sink,
    checkpoint: str,
    log_path: str,
    interval: str | None = None,
) -> StreamingQuery:
    """The weather producer as a stream: every landed document becomes a message, sent once landed;
    what each batch sent and failed to send goes to the log table."""

    def send(batch: DataFrame, batch_id: int) -> None:
        messages = feeds.weather_message(documents.weather(batch), city)
        write_log(spark, publish(messages, sink, required=["location"]).log("environment_producer"), log_path)

    landed = documents.read_documents(spark, path, stream=True)
    stream = landed.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()
