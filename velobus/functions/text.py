"""Sentences, titles and metadata of scored records, as column expressions."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.schemas import WEATHER_COLS

# Texts shown to readers and stored with the documents.
NO_TIME = "Brak czasu"
BAD_TIME = "Nieznany czas"
NOT_AVAILABLE = "N/A"
CLIPPED_NOTE = "(Prognoza była ujemna i została obcięta do zera)."

BIKE_METADATA = [
    "bikes_available", "capacity", "docks_available", "manual_bikes_available",
    "electric_bikes_available", *WEATHER_COLS, "cluster_id", "cluster_prediction_success",
    "bike_binary_prediction", "bike_binary_probabilities", "bike_binary_prediction_success",
    "bike_binary_label", "bike_multiclass_prediction", "bike_multiclass_probabilities",
    "bike_multiclass_prediction_success", "bike_multiclass_label", "bike_regression_prediction",
    "bike_regression_prediction_original", "bike_regression_prediction_success",
]
BUS_METADATA = [
    "route_destination", "lat", "lon", "speed", "direction", "trip_identifier",
    "route_identifier", "stops_count", "average_delay_seconds", "maximum_delay_seconds",
    "minimum_delay_seconds", "delay_variance_value", "delay_standard_deviation",
    "delay_range_seconds", "stops_on_time_count", "stops_arrived_early_count",
    "stops_arrived_late_count", "delay_trend", "delay_consistency_score", "on_time_stop_ratio",
    "avg_positive_delay_seconds", "avg_negative_delay_seconds", *WEATHER_COLS, "cluster_id",
    "cluster_prediction_success", "is_late_prediction", "is_late_probabilities",
    "is_late_prediction_success", "is_late_label", "delay_category_prediction",
    "delay_category_probabilities", "delay_category_prediction_success", "delay_category_label",
    "average_delay_seconds_prediction", "average_delay_seconds_prediction_original",
    "average_delay_seconds_prediction_success",
]


def text(pattern: str, *values: Column) -> Column:
    """The pattern with its values filled in; null when one of them is null.

    %s parts are plain concatenation, which the generated code does far faster than a formatter;
    only numbers (%.1f) go through the formatter.
    """
    parts, rest = [], iter(values)
    for piece in re.split(r"(%s|%\.\df)", pattern):
        if piece == "%s":
            parts.append(next(rest))
        elif piece.startswith("%."):
            value = next(rest)
            parts.append(F.when(value.isNotNull(), F.format_string(piece, value)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _optional(frame: DataFrame):
    """Columns by name; a column the frame lacks reads as null."""
    return lambda name, kind="string": (
        F.col(name) if name in frame.columns else F.lit(None).cast(kind)
    )


def filled(value: Column) -> Column:
    """The text itself, or null when it is empty."""
    return F.nullif(value.cast("string"), F.lit(""))


def display_time(stamp: Column) -> Column:
    """Epoch seconds or milliseconds as 'YYYY-MM-DD HH:MM'; text that is no number has its own."""
    epoch = stamp.cast("string").try_cast("bigint")
    seconds = F.when(epoch > 10**10, F.timestamp_millis(epoch)).otherwise(
        F.timestamp_seconds(epoch)
    )
    return (
        F.when(stamp.isNull(), NO_TIME)
        .when(epoch.isNull(), BAD_TIME)
        .otherwise(F.date_format(seconds, "yyyy-MM-dd HH:mm"))
    )


def _weather_parts(col) -> list[Column]:
    """Weather sentence and air quality sentence; null when nothing is known."""
    known = F.concat_ws(
        ", ",
        text("warunki pogodowe: %s", filled(col("weather_condition"))),
        text("temperatura: %.1f°C", col("temperature", "double").cast("double")),
        text("wiatr: %.1f km/h", col("wind_kph", "double").cast("double")),
        F.when(
            col("precip_mm", "double") > 0,
            text("opady: %.1f mm", col("precip_mm", "double").cast("double")),
        ),
    )
    air = text(
        "Jakość powietrza: PM2.5 na poziomie %.1f µg/m³, PM10 na poziomie %.1f µg/m³.",
        col("fine_particles_pm2_5", "double").cast("double"),
        col("coarse_particles_pm10", "double").cast("double"),
    )
    return [text("Aktualne %s.", filled(known)), air]


def bike_sentence(frame: DataFrame) -> Column:
    """Summary sentence of a scored station record."""
    col = _optional(frame)
    name, station = filled(col("name")), filled(col("station_id"))
    capacity = col("capacity", "int").cast("string")
    bikes = col("bikes_available", "int").cast("string")
    docks = col("docks_available", "int").cast("string")
    manual = F.coalesce(col("manual_bikes_available", "int"), F.lit(0)).cast("string")
    electric = F.coalesce(col("electric_bikes_available", "int"), F.lit(0)).cast("string")
    forecast = col("bike_regression_prediction", "double").cast("double")
    original = F.coalesce(
        col("bike_regression_prediction_original", "double").cast("double"), forecast
    )
    station_part = F.coalesce(
        text("Stacja rowerowa '%s' (ID: %s) o pojemności %s miejsc.", name, station, capacity),
        text("Stacja rowerowa '%s' (ID: %s).", name, station),
        text("Stacja rowerowa o ID %s o pojemności %s miejsc.", station, capacity),
        text("Stacja rowerowa o ID %s.", station),
        F.lit("Nieznana stacja rowerowa."),
    )
    available = F.coalesce(
        text(
            "Aktualnie dostępnych jest %s rowerów (w tym %s manualnych i %s elektrycznych) "
            "oraz %s wolnych doków.",
            bikes, manual, electric, docks,
        ),
        text("Dostępnych rowerów: %s.", bikes),
        text("Wolnych doków: %s.", docks),
    )
    return F.concat_ws(
        " ",
        station_part,
        available,
        text("Stacja została przypisana do klastra %s.", col("cluster_id", "int").cast("string")),
        text("Przewidywany status stacji: %s.", filled(col("bike_binary_label"))),
        text("Kategoria dostępności rowerów: %s.", filled(col("bike_multiclass_label"))),
        text(
            "Przewidywana liczba dostępnych rowerów w przyszłości: %.0f.",
            F.when(forecast.isNotNull(), F.greatest(F.lit(0.0), forecast)),
        ),
        F.when(original < 0, CLIPPED_NOTE),
        *_weather_parts(col),
    )


def bus_sentence(frame: DataFrame) -> Column:
    """Summary sentence of a scored bus record."""
    col = _optional(frame)
    line = F.coalesce(col("bus_line_number"), F.lit("nieznana linia"))
    target = F.coalesce(col("route_destination"), F.lit("nieznany cel"))
    forecast = col("average_delay_seconds_prediction", "double").cast("double")
    was_clipped = (
        col("average_delay_seconds_prediction_success", "boolean")
        & (forecast == 0)
        & (col("average_delay_seconds_prediction_original", "double") < 0)
    )
    return F.concat_ws(
        " ",
        F.coalesce(
            text(
                "Przejazd autobusu linii %s (ID podróży: %s) w kierunku %s.",
                line, col("trip_identifier").cast("string"), target,
            ),
            text("Autobus linii %s w kierunku %s.", line, target),
        ),
        text("Został przypisany do klastra %s.", col("cluster_id", "int").cast("string")),
        text("Przewidywany status: %s.", filled(col("is_late_label"))),
        text("Kategoria opóźnienia: %s.", filled(col("delay_category_label"))),
        text("Przewidywane opóźnienie: %.0f sekund.", forecast),
        F.when(was_clipped, CLIPPED_NOTE),
        *_weather_parts(col),
    )


def _as_text(frame: DataFrame, name: str) -> Column:
    """A field as metadata text: dates in ISO form, nested values as JSON, null as 'N/A'."""
    if name not in frame.columns:
        return F.lit(NOT_AVAILABLE)
    kind = frame.schema[name].dataType.typeName()
    if kind in ("array", "map", "struct"):
        value = F.to_json(name)
    elif kind == "timestamp":
        value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX")
    elif kind == "timestamp_ntz":
        value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        value = F.col(name).cast("string")
    return F.coalesce(value, F.lit(NOT_AVAILABLE))


def metadata_map(frame: DataFrame, title: Column, fields: dict[str, Column]) -> Column:
    """One map of title and fields; every value is text and none is null."""
    pairs = [F.lit("title"), title]
    for name, value in fields.items():
        pairs += [F.lit(name), value]
    return F.create_map(*pairs)


def bike_metadata(frame: DataFrame, stamp: str = "timestamp") -> Column:
    col = _optional(frame)
    shown = display_time(col(stamp, "bigint"))
    title = text(
        "Dane dla stacji: %s (ID: %s) - %s",
        F.coalesce(col("name"), F.lit("Brak nazwy")),
        F.coalesce(col("station_id"), F.lit("Brak ID")),
        shown,
    )
    fields = {
        "station_id": _as_text(frame, "station_id"),
        "station_name": _as_text(frame, "name"),
        "timestamp": shown,
    }
    return metadata_map(frame, title, fields | {c: _as_text(frame, c) for c in BIKE_METADATA})


def bus_metadata(frame: DataFrame, stamp: str = "timestamp") -> Column:
    col = _optional(frame)
    shown = display_time(col(stamp, "bigint"))
    title = text(
        "Autobus Linii %s (%s) - Cel: %s - %s",
        F.coalesce(col("bus_line_number"), F.lit("Brak Linii")),
        F.coalesce(col("vehicle_id"), F.lit("Brak ID")),
        F.coalesce(col("route_destination"), F.lit("Brak Celu")),
        shown,
    )
    fields = {
        "vehicle_id": _as_text(frame, "vehicle_id"),
        "bus_line_number": _as_text(frame, "bus_line_number"),
        "timestamp": shown,
    }
    return metadata_map(frame, title, fields | {c: _as_text(frame, c) for c in BUS_METADATA})
