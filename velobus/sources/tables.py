"""Bounded scans over the stored tables."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.schemas import (
    BIKE_TARGET_COLS,
    BUS_TARGET_COLS,
    CLASS_BIKE_FEATURES,
    CLASS_BUS_FEATURES,
    CLUSTER_BIKE_FEATURES,
    CLUSTER_BUS_FEATURES,
    TRAINING_WINDOW_DAYS,
)

AsOf = Column | datetime | str | None


def instant(as_of: AsOf) -> Column:
    """The end of a horizon: a column, a literal, or now."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def latest_instant(frame: DataFrame, time: str = "timestamp") -> Column:
    """The newest time in the table, as a scalar subquery."""
    return frame.agg(F.max(time)).scalar()


def within(
    frame: DataFrame,
    as_of: AsOf = None,
    hours: int | None = None,
    days: int | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """Rows of the last N hours or days before ``as_of``; the bound reaches the file scan.

    Of a table stored by ``event_date`` (the date of ``timestamp``) only the folders of those days
    are read.
    """
    if hours is None and days is None:
        return frame
    bound = instant(as_of) - F.make_dt_interval(F.lit(days or 0), F.lit(hours or 0))
    if time == "timestamp" and "event_date" in frame.columns:
        frame = frame.where(F.col("event_date") >= F.to_date(bound))
    return frame.where(F.col(time) >= bound)


def training_scan(
    frame: DataFrame, columns: list[str], days: int, as_of: AsOf = None, time: str = "timestamp"
) -> DataFrame:
    """Recent rows with only the wanted columns; columns the table lacks are skipped."""
    present = [c for c in dict.fromkeys(columns) if c in frame.columns]
    return within(frame, as_of, days=days, time=time).select(*present)


def cluster_training_scan(frame: DataFrame, sector: str, as_of: AsOf = None) -> DataFrame:
    columns = CLUSTER_BIKE_FEATURES if sector == "bikes" else CLUSTER_BUS_FEATURES
    return training_scan(frame, columns, TRAINING_WINDOW_DAYS["cluster"], as_of)


def class_training_scan(frame: DataFrame, sector: str, as_of: AsOf = None) -> DataFrame:
    features, targets = (
        (CLASS_BIKE_FEATURES, BIKE_TARGET_COLS)
        if sector == "bikes"
        else (CLASS_BUS_FEATURES, BUS_TARGET_COLS)
    )
    return training_scan(
        frame, features + targets, TRAINING_WINDOW_DAYS[f"class_{sector}"], as_of
    )


def unscored_condition() -> Column:
    """An answer without error that still lacks a score."""
    lacking = F.col("bleu_score").isNull() | F.col("rouge_score").isNull()
    return lacking & ~F.col("llm_error")


def unscored_answers(answers: DataFrame) -> DataFrame:
    return answers.where(unscored_condition())
