"""Feed documents: landing files with one JSON document each, as batch or stream."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.schemas import (
    DEPARTURES_MAP,
    NO_NAME,
    STATION_INFO_DOC,
    STATION_STATUS_DOC,
    VEHICLE_POSITIONS_DOC,
    WEATHER_DOC,
)


def read_documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per landed file: its text in "value", its path in "file", its poll in "poll".

    The files that one poll lands carry its number (the poll's epoch seconds) at the start of
    their names, in every feed; a file without a number belongs to poll -1.
    """
    path_of = F.col("_metadata.file_path")
    number = F.regexp_extract(path_of, "/([0-9]+)[^/]*$", 1).try_cast("bigint")
    poll = F.coalesce(number, F.lit(-1)).alias("poll")
    if stream:
        # A file stream needs its schema up front; a whole-text file is one string column.
        reader = spark.readStream.schema("value STRING").option("wholetext", True)
        return reader.text(path).select("value", path_of.alias("file"), poll)
    reader = spark.read.option("wholetext", True)
    return reader.text(path).select("value", path_of.alias("file"), poll)


def _listed(documents: DataFrame, schema: str, path: str) -> DataFrame:
    """The elements of one array of the document with their place; no array gives no row."""
    parsed = documents.select("poll", "file", F.from_json("value", schema).alias("doc"))
    items = parsed.select("poll", "file", F.posexplode(f"doc.{path}").alias("place", "item"))
    return items.select("poll", F.struct("file", "place").alias("ord"), "item.*")


def station_info(documents: DataFrame) -> DataFrame:
    return _listed(documents, STATION_INFO_DOC, "data.stations")


def exact_station_info(documents: DataFrame) -> DataFrame:
    """As station_info(), with the defaults of keys that a station does not have at all; a key that
    is there and null stays null."""
    listed = F.try_variant_get(F.parse_json("value"), "$.data.stations", "array<variant>")
    items = documents.select("poll", "file", F.posexplode(listed).alias("place", "v"))

    def field(name: str, kind: str, default):
        path = f"$.{name}"
        absent = F.try_variant_get("v", path, "variant").isNull()
        return F.when(absent, F.lit(default).cast(kind)).otherwise(F.try_variant_get("v", path, kind)).alias(name)

    return items.select(
        "poll",
        F.struct("file", "place").alias("ord"),
        F.try_variant_get("v", "$.station_id", "string").alias("station_id"),
        field("name", "string", NO_NAME),
        field("capacity", "int", 0),
    )


def station_status(documents: DataFrame) -> DataFrame:
    return _listed(documents, STATION_STATUS_DOC, "data.stations")


def vehicle_positions(documents: DataFrame) -> DataFrame:
    return _listed(documents, VEHICLE_POSITIONS_DOC, "vehicles")


def departures(documents: DataFrame) -> DataFrame:
    """Departures of all stops; ``ord`` is (file, stop place, departure place) in feed order."""
    parsed = documents.select("poll", "file", F.from_json("value", DEPARTURES_MAP).alias("stops"))
    stops = parsed.select(
        "poll", "file", F.posexplode(F.map_entries("stops")).alias("stop_place", "stop")
    )
    each = stops.select(
        "poll",
        "file",
        "stop_place",
        F.col("stop.key").alias("stop_id"),
        F.posexplode("stop.value.departures").alias("place", "d"),
    )
    order = F.struct("file", "stop_place", "place").alias("ord")
    return each.select("poll", order, "stop_id", "d.*")


def weather(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("value", WEATHER_DOC).alias("doc")).select("doc.*")


def missing_key(value: Column, path: str) -> Column:
    """True when a JSON document has no such key; an explicit null counts as present."""
    return F.try_variant_get(F.parse_json(value), path, "variant").isNull()


def default_when_missing(value: Column, path: str, kind: str, default) -> Column:
    """The exact default rule: only an absent key gets the default, an explicit null stays null."""
    found = F.try_variant_get(F.parse_json(value), path, kind)
    return F.when(missing_key(value, path), F.lit(default).cast(kind)).otherwise(found)
