"""Feed documents to messages: station merge, departures grouped into trips, weather."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.schemas import NO_NAME


def keep_last(frame: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """Keep the row with the highest position per key; one row per key and task is shuffled."""
    rest = [c for c in frame.columns if c not in keys]
    last = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def latest_per_key(
    frame: DataFrame, keys: list[str], order: list[str | Column], columns: list[str]
) -> DataFrame:
    """The given columns of the latest row per key; ``order`` ends with a tie-break."""
    latest = frame.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    )
    return latest.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def has_prefix(name: Column, prefix: str) -> Column:
    return F.coalesce(name, F.lit("")).startswith(prefix)


def type_counts(vehicle_types: Column) -> Column:
    """[{vehicle_type_id, count}] as a map; empty ids are skipped, the last duplicate wins."""
    listed = F.filter(
        vehicle_types,
        lambda v: v["vehicle_type_id"].isNotNull() & (v["vehicle_type_id"] != ""),
    )
    ids = F.transform(listed, lambda v: v["vehicle_type_id"])
    backwards = F.reverse(ids)
    # An entry is the last of its id when the id's first hit from the back points to it.
    last = F.filter(
        listed,
        lambda v, i: F.array_position(backwards, v["vehicle_type_id"]) == F.size(ids) - i,
    )
    return F.map_from_entries(
        F.transform(
            last, lambda v: F.struct(v["vehicle_type_id"], F.coalesce(v["count"], F.lit(0)))
        )
    )


def project_types(messages: DataFrame, types: str = "vehicle_types_available") -> DataFrame:
    """Replace the type map by one column per vehicle type, absent meaning 0."""
    return messages.select(
        *[c for c in messages.columns if c != types],
        F.coalesce(F.try_element_at(types, F.lit("bike")), F.lit(0)).alias("bike_available"),
        F.coalesce(F.try_element_at(types, F.lit("ebike")), F.lit(0)).alias("ebike_available"),
    )


def merge_stations(
    info: DataFrame,
    status: DataFrame,
    status_position: Column,
    prefix: str | None,
    ingest_ts: Column | None = None,
    snapshot: tuple[str, ...] = (),
    exact: bool = False,
) -> DataFrame:
    """Station info left-joined to the last status per station, with defaults.

    ``snapshot`` names the columns that tell polls apart: each poll is merged within itself. With
    ``exact`` the info has its defaults already (exact_station_info), and its nulls stay.
    """
    keys = [*snapshot, "station_id"]
    latest = keep_last(status, keys, status_position)
    ingest_ts = F.unix_timestamp() if ingest_ts is None else ingest_ts
    zero = F.lit(0)
    no_types = F.create_map().cast("map<string,int>")
    merged = info.join(latest, keys, "left").select(
        ingest_ts.cast("bigint").alias("timestamp"),
        "station_id",
        F.col("name") if exact else F.coalesce("name", F.lit(NO_NAME)).alias("name"),
        F.col("capacity") if exact else F.coalesce("capacity", zero).alias("capacity"),
        F.coalesce("num_bikes_available", zero).alias("bikes_available"),
        F.coalesce("num_docks_available", zero).alias("docks_available"),
        F.coalesce(type_counts(F.col("vehicle_types_available")), no_types).alias(
            "vehicle_types_available"
        ),
    )
    return merged.where(has_prefix(F.col("name"), prefix)) if prefix else merged


def attach_positions(
    departures: DataFrame,
    positions: DataFrame,
    position_order: Column,
    snapshot: tuple[str, ...] = (),
) -> DataFrame:
    """Departures left-joined to the last vehicle position; rows without vehicle or trip go.

    Zero is no vehicle id. The vehicle's own headsign wins when it is not empty. Within the columns
    of ``snapshot``, departures only meet positions of their own poll.
    """
    keys = [*snapshot, "vehicleId"]
    latest = keep_last(positions, keys, position_order).withColumnRenamed(
        "headsign", "_position_headsign"
    )
    valid = departures.where(
        F.col("vehicleId").isNotNull() & (F.col("vehicleId") != 0) & F.col("tripId").isNotNull()
    )
    joined = valid.join(latest, keys, "left")
    shown = F.coalesce(F.nullif("_position_headsign", F.lit("")), F.col("headsign"))
    return joined.withColumn("headsign", shown).drop("_position_headsign")


def trip_messages(
    located: DataFrame, ingest_ts: Column | None = None, snapshot: tuple[str, ...] = ()
) -> DataFrame:
    """One bus message per (poll, vehicle, trip) with its stops in feed order.

    ``located`` has the departure columns, the position columns and ``ord``, the place of the
    departure in the feed. Scalar fields come from the trip's first departure. A message holds
    one trip of one snapshot, so its stop list is as long as the trip has stops.
    """
    first = F.min_by(
        F.struct("routeShortName", "headsign", "lat", "lon", "speed", "direction", "routeId"),
        F.col("ord"),
    )
    stop = F.struct(
        "ord",
        "stop_id",
        F.col("delayInSeconds").alias("delay"),
        F.col("estimatedTime").alias("estimated_departure"),
        F.col("theoreticalTime").alias("scheduled_departure"),
    )
    ingest_ts = F.unix_timestamp() if ingest_ts is None else ingest_ts
    grouped = located.groupBy(*snapshot, "vehicleId", "tripId").agg(
        first.alias("f"), F.array_sort(F.collect_list(stop)).alias("stops")
    )
    return grouped.select(
        ingest_ts.cast("bigint").alias("timestamp"),
        F.col("vehicleId").cast("string").alias("vehicle_id"),
        F.col("f.routeShortName").alias("line"),
        F.col("f.headsign").alias("headsign"),
        "f.lat",
        "f.lon",
        "f.speed",
        "f.direction",
        F.col("tripId").cast("string").alias("trip_id"),
        F.col("f.routeId").cast("string").alias("route_id"),
        F.transform("stops", lambda s: s.dropFields("ord")).alias("estimated_stops"),
    )


def trip_summary(
    located: DataFrame, keys: list[str], position: Column, first: list[str], last: list[str]
) -> DataFrame:
    """The same grouping without the list: stop count, fields of the first and the last stop."""
    grouped = located.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stops_count"),
        F.min_by(F.struct(*first), position).alias("_first"),
        F.max_by(F.struct(*last), position).alias("_last"),
    )
    return grouped.select(
        *keys,
        "stops_count",
        *[F.col("_first")[c].alias(f"first_{c}") for c in first],
        *[F.col("_last")[c].alias(f"last_{c}") for c in last],
    )


def daylight_flag(is_day: Column) -> Column:
    return F.when(is_day == 1, "yes").otherwise("no")


def weather_message(weather: DataFrame, city: str, ingest_ts: Column | None = None) -> DataFrame:
    """Weather documents as environment messages."""
    now = F.col("current")
    ingest_ts = F.unix_timestamp() if ingest_ts is None else ingest_ts
    return weather.select(
        F.lit("environment").alias("type"),
        ingest_ts.cast("bigint").alias("timestamp"),
        F.struct(
            F.lit(city).alias("city"),
            F.col("location.lat").alias("lat"),
            F.col("location.lon").alias("lon"),
        ).alias("location"),
        F.struct(
            now["temp_c"].alias("temperature"),
            now["feelslike_c"].alias("feelslike"),
            now["humidity"].alias("humidity"),
            now["wind_kph"].alias("wind_kph"),
            now["precip_mm"].alias("precip_mm"),
            now["cloud"].alias("cloud"),
            now["vis_km"].alias("visibility_km"),
            now["uv"].alias("uv_index"),
            daylight_flag(now["is_day"]).alias("is_day"),
            now["condition"]["text"].alias("condition"),
        ).alias("weather"),
        F.struct(
            *[
                now["air_quality"][c].alias(c)
                for c in ("pm2_5", "pm10", "co", "no2", "o3", "so2")
            ]
        ).alias("air_quality"),
    )


def flatten_environment(messages: DataFrame) -> DataFrame:
    """Environment messages as flat table rows."""
    return messages.select(
        F.coalesce("type", F.lit("environment")).alias("type"),
        epoch_instant(F.col("timestamp")).alias("timestamp"),
        "location.city",
        "location.lat",
        "location.lon",
        "weather.*",
        "air_quality.*",
    )


def epoch_instant(seconds: Column) -> Column:
    """Epoch seconds as an instant; a missing stamp means now."""
    return F.timestamp_seconds(F.coalesce(seconds, F.unix_timestamp()))
