"""Streaming jobs: environment ingest, and the scoring pipeline for stations and buses."""

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velobus.functions.text import bike_metadata, bike_sentence, bus_metadata, bus_sentence
from velobus.ml import scoring
from velobus.ml.registry import ModelCache
from velobus.operators.delays import with_delay_statistics
from velobus.operators.feeds import epoch_instant, flatten_environment, project_types
from velobus.operators.records import (
    enrich_with_environment,
    rename_columns,
    replace_nulls,
    split_incomplete,
)
from velobus.schemas import (
    BIKE_BINARY_LABELS,
    BIKE_MULTICLASS_LABELS,
    CLASS_BIKE_FEATURES,
    CLASS_BUS_FEATURES,
    CLUSTER_BIKE_FEATURES,
    CLUSTER_BUS_FEATURES,
    DELAY_CATEGORY_LABELS,
    ENVIRONMENT_TABLE,
    IS_LATE_LABELS,
    UNKNOWN_LABELS,
)
from velobus.session import wide_records
from velobus.sinks import commits, tables
from velobus.sinks.log import write_log
from velobus.sources.topics import parse

Models = dict[str, PipelineModel]


def prepare_bikes(messages: DataFrame, environment: DataFrame) -> DataFrame:
    """Station messages: types projected, weather attached, names and nulls settled."""
    flat = project_types(messages).withColumn("event_time", epoch_instant(F.col("timestamp")))
    return replace_nulls(rename_columns(enrich_with_environment(flat, environment)))


def prepare_buses(messages: DataFrame, environment: DataFrame) -> DataFrame:
    """Bus messages: stop list to delay statistics, weather attached, names and nulls settled."""
    flat = with_delay_statistics(messages).withColumn(
        "event_time", epoch_instant(F.col("timestamp"))
    )
    return replace_nulls(rename_columns(enrich_with_environment(flat, environment)))


def score_bikes(records: DataFrame, models: Models) -> DataFrame:
    scored = scoring.score_cluster(records, models.get("bikes_kmeans"), CLUSTER_BIKE_FEATURES)
    scored = scoring.score_classes(
        scored, models.get("bikes_binary_classifier"), CLASS_BIKE_FEATURES, "bike_binary",
        BIKE_BINARY_LABELS, UNKNOWN_LABELS["bike_binary"],
    )
    scored = scoring.score_classes(
        scored, models.get("bikes_multiclass_classifier"), CLASS_BIKE_FEATURES, "bike_multiclass",
        BIKE_MULTICLASS_LABELS, UNKNOWN_LABELS["bike_multiclass"],
    )
    return scoring.score_regression(
        scored, models.get("bikes_regression_predictor"), CLASS_BIKE_FEATURES, "bike_regression"
    )


def score_buses(records: DataFrame, models: Models) -> DataFrame:
    scored = scoring.score_cluster(records, models.get("buses_kmeans"), CLUSTER_BUS_FEATURES)
    scored = scoring.score_classes(
        scored, models.get("bus_binary_classifier"), CLASS_BUS_FEATURES, "is_late",
        IS_LATE_LABELS, UNKNOWN_LABELS["is_late"],
    )
    scored = scoring.score_classes(
        scored, models.get("bus_multiclass_classifier"), CLASS_BUS_FEATURES, "delay_category",
        DELAY_CATEGORY_LABELS, UNKNOWN_LABELS["delay_category"],
    )
    return scoring.score_regression(
        scored, models.get("bus_regression_predictor"), CLASS_BUS_FEATURES, "average_delay_seconds"
    )


@dataclass(frozen=True)
class Sector:
    """What differs between the two vehicle streams."""

    topic: str
    prepare: Callable[[DataFrame, DataFrame], DataFrame]
    score: Callable[[DataFrame, Models], DataFrame]
    sentence: Callable[[DataFrame], Column]
    metadata: Callable[[DataFrame], Column]


BIKES = Sector("bikes", prepare_bikes, score_bikes, bike_sentence, bike_metadata)
BUSES = Sector("buses", prepare_buses, score_buses, bus_sentence, bus_metadata)


def score_records(
    sector: Sector, messages: DataFrame, environment: DataFrame, models: Models
) -> tuple[DataFrame, DataFrame]:
    """(scored rows with sentence and metadata, rows dropped for missing values)."""
    return finish_records(sector, sector.prepare(messages, environment), models)


def finish_records(
    sector: Sector, prepared: DataFrame, models: Models
) -> tuple[DataFrame, DataFrame]:
    complete, dropped = split_incomplete(prepared)
    scored = sector.score(complete, models)
    scored = scored.withColumn("summary_sentence", sector.sentence(scored))
    return scored.withColumn("metadata", sector.metadata(scored)), dropped


@dataclass
class Paths:
    """Folders below one root that every executor can reach."""

    root: str
    name: str
    rows: str = field(init=False)
    documents: str = field(init=False)
    quarantine: str = field(init=False)
    log: str = field(init=False)
    commits: str = field(init=False)
    checkpoint: str = field(init=False)

    def __post_init__(self):
        for part in ("rows", "documents", "quarantine", "log", "commits", "checkpoint"):
            setattr(self, part, f"{self.root.rstrip('/')}/{self.name}/{part}")

    def read(self, spark: SparkSession, part: str, schema: str | None = None) -> DataFrame:
        """The committed rows of one part; of a part that no batch has written, an empty frame
        (for which the schema must be given)."""
        known = commits.records(spark, self.commits).values()
        folders = [r["folders"][part] for r in known if part in r["folders"]]
        kind = "json" if part == "documents" else "parquet"
        if schema is None and folders:
            return spark.read.option("basePath", getattr(self, part)).format(kind).load(folders)
        return commits.read_folders(spark, getattr(self, part), folders, schema or "batch_id INT", kind)


def read_environment(spark: SparkSession, path: str) -> DataFrame:
    """The environment table in a plain folder as it is now; empty before its first batch."""
    try:
        return spark.read.schema(ENVIRONMENT_TABLE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENVIRONMENT_TABLE)


def days_around(days: set[str], first: date, last: date) -> list[str]:
    """Of the days that have readings: those from first to last, the last one before and the first
    one after. They hold the nearest reading, earlier and later, of every instant between."""
    low, high = first.isoformat(), last.isoformat()
    before = [d for d in days if d < low]
    after = [d for d in days if d > high]
    return sorted([d for d in days if low <= d <= high] + ([max(before)] if before else []) + ([min(after)] if after else []))


def environment_near(spark: SparkSession, paths: Paths, instants: DataFrame, column: str) -> DataFrame:
    """The committed readings that can be the nearest to any of these instants.

    The commit records tell which days have readings, so only the folders of the days around the
    instants are read: what a micro-batch reads depends on the days it spans, not on the history.
    """
    span = instants.agg(F.to_date(F.min(column)), F.to_date(F.max(column))).first()
    known = list(commits.records(spark, paths.commits).values())
    if span[0] is None:
        return spark.createDataFrame([], ENVIRONMENT_TABLE)
    days = days_around({d for r in known for d in r["days"]}, *span)
    folders = [f"{r['folders']['rows']}/event_date={d}" for r in known for d in r["days"] if d in days]
    return commits.read_folders(spark, paths.rows, folders, ENVIRONMENT_TABLE)


def _trigger(stream, interval: str | None):
    return stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)


class Batch:
    """The outputs of one micro-batch: written to folders of this attempt, then committed at once.

    A batch that was committed is never written again, however often the stream repeats it. A batch
    whose attempt failed between two outputs has no record, so none of them is read. A stream with a
    new checkpoint has another run id and overwrites nothing.
    """

    def __init__(self, spark: SparkSession, paths: Paths, batch_id: int):
        self.spark, self.paths, self.batch_id = spark, paths, batch_id
        self.run = commits.run_id(spark, paths.checkpoint)
        self.name = f"{self.run}-{batch_id}"
        self.folders: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.days: list[str] = []

    def done(self) -> bool:
        return self.name in commits.records(self.spark, self.paths.commits)

    def write(self, part: str, frame: DataFrame, writer: Callable[[DataFrame, str], None], **counts: Column) -> None:
        """Write one output and count its rows, and those of each condition, on the way."""
        seen = Observation(f"{part}-{self.name}")
        watched = frame.observe(seen, F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in counts.items()])
        folder = commits.attempt_folder(getattr(self.paths, part), self.run, self.batch_id)
        writer(watched, folder)
        found = seen.get
        self.counts |= {n: found.get(n) or 0 for n in counts}
        if found.get("_n"):
            self.folders[part] = folder

    def commit(self, service: str) -> None:
        """The log rows of the batch, then its record."""
        levels = {"unreadable": "ERROR", "incomplete": "WARNING", "speechless": "WARNING"}
        events = [(service, levels.get(n, "INFO"), n, v) for n, v in self.counts.items()]
        folder = commits.attempt_folder(self.paths.log, self.run, self.batch_id)
        write_log(self.spark, events, folder)
        self.folders["log"] = folder
        record = {
            "run": self.run, "batch": self.batch_id, "folders": self.folders, "days": self.days,
            "counts": self.counts, "at": datetime.now(timezone.utc).isoformat(),
        }
        commits.commit(self.spark, self.paths.commits, self.name, record)


def ingest_environment(
    values: DataFrame, paths: Paths, interval: str | None = None
) -> StreamingQuery:
    """Store environment messages by day; text that is no message goes to the quarantine."""

    def store(frame: DataFrame, batch_id: int) -> None:
        batch = Batch(frame.sparkSession, paths, batch_id)
        if batch.done():
            return
        parsed = parse(frame, "environment")
        good = parsed.where(~F.col("bad")).drop("value", "bad")
        typed = flatten_environment(good).select(
            *[F.col(c.name).try_cast(c.dataType) for c in _environment_fields()]
        )
        days = Observation(f"days-{batch.name}")
        dated = typed.observe(days, F.collect_set(F.to_date("timestamp").cast("string")).alias("days"))
        batch.write("rows", dated, tables.write_dated, stored=F.lit(True))
        batch.days = sorted(days.get.get("days") or [])
        bad = parsed.where("bad").select("value")
        batch.write("quarantine", bad, tables.write_plain, unreadable=F.lit(True))
        batch.commit("environment")

    stream = values.writeStream.foreachBatch(store).option("checkpointLocation", paths.checkpoint)
    return _trigger(stream, interval).start()


def _environment_fields():
    from velobus.schemas import struct_type

    return struct_type(ENVIRONMENT_TABLE).fields


def run_sector(
    sector: Sector,
    values: DataFrame,
    environment: Paths | str,
    paths: Paths,
    workspace: str,
    cache: ModelCache | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """The scoring stream of one sector.

    Per micro-batch: the weather of the days around its records and the model registry are read, the
    batch is scored, then documents, rows, rejected records and log rows are written and committed
    together (Batch). ``environment`` is the ingest job's folders, or a plain folder of weather rows,
    which is read whole.
    """

    def process(frame: DataFrame, batch_id: int) -> None:
        batch = Batch(frame.sparkSession, paths, batch_id)
        if batch.done():
            return
        models = cache.refresh() if cache else {}
        with wide_records(frame.sparkSession):
            process_batch(frame, batch, models)

    def process_batch(frame: DataFrame, batch: Batch, models: Models) -> None:
        spark = frame.sparkSession
        parsed = parse(frame, sector.topic)
        messages = parsed.where(~F.col("bad")).drop("value", "bad")
        if isinstance(environment, Paths):
            instants = messages.select(epoch_instant(F.col("timestamp")).alias("at"))
            weather = environment_near(spark, environment, instants, "at")
        else:
            weather = read_environment(spark, environment)
        # Read twice (complete and dropped rows), and written twice after scoring. A lost
        # executor only means computing its part again.
        prepared = sector.prepare(messages, weather).persist(StorageLevel.MEMORY_AND_DISK)
        scored, dropped = finish_records(sector, prepared, models)
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            said = F.col("summary_sentence") != ""
            accepted = scored.where(said)
            feed = tables.documents(accepted, "summary_sentence", F.col("metadata"), workspace)
            batch.write("documents", feed, tables.write_json)
            rows = accepted.drop("metadata").withColumn("timestamp", F.col("event_time"))
            clustered = F.col("cluster_prediction_success")
            batch.write("rows", rows.drop("event_time"), tables.write_dated, stored=F.lit(True), clustered=clustered)

            def rejected(rows: DataFrame, reason: str, record: Column) -> DataFrame:
                return rows.select(F.lit(reason).alias("reason"), record.alias("record"))

            whole = F.to_json(F.struct("*"))
            quarantine = (
                rejected(parsed.where("bad"), "unreadable", F.col("value"))
                .unionByName(rejected(dropped, "missing value", whole))
                .unionByName(rejected(scored.where(~said), "no sentence", whole))
            )
            reason = F.col("reason")
            batch.write(
                "quarantine", quarantine, tables.write_plain, unreadable=reason == "unreadable",
                incomplete=reason == "missing value", speechless=reason == "no sentence",
            )
            kept = ("stored", "unreadable", "incomplete", "speechless")
            batch.counts["read"] = sum(batch.counts[n] for n in kept)
            batch.commit(sector.topic)
        finally:
            scored.unpersist()
            prepared.unpersist()

    stream = values.writeStream.foreachBatch(process).option(
        "checkpointLocation", paths.checkpoint
    )
    return _trigger(stream, interval).start()


def rolling_counts(
    rows: DataFrame, time: str, flags: dict[str, Column], window: str = "2 hours",
    delay: str = "10 minutes",
) -> DataFrame:
    """The recurring report as a windowed stream: totals and flag counts per closed window."""
    counted = (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, window))
        .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    )
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "total",
        *flags,
    )
