"""Row policies between enrichment and scoring: names, nulls, labels, clipping."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.operators.asof import nearest_join
from velobus.schemas import ENV_COLS, RENAME_MAP, UNKNOWN_WHEN_NULL, ZERO_WHEN_NULL


def enrich_with_environment(
    facts: DataFrame, environment: DataFrame, fact_time: str = "event_time", **options
) -> DataFrame:
    """Attach the nearest weather row; decimals of the table become doubles."""
    typed = environment.select(
        "timestamp",
        *[
            F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
            for c, t in environment.select(*ENV_COLS).dtypes
        ],
    )
    return nearest_join(facts, typed, fact_time, "timestamp", ENV_COLS, **options)


def rename_columns(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed(RENAME_MAP)


def replace_nulls(frame: DataFrame) -> DataFrame:
    """Five text columns become 'unknown', four numeric ones 0.0; other nulls stay."""
    fills = {c: "unknown" for c in UNKNOWN_WHEN_NULL if c in frame.columns}
    fills |= {c: 0.0 for c in ZERO_WHEN_NULL if c in frame.columns}
    return frame.fillna(fills)


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def split_incomplete(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and the rows dropped because some column is still null."""
    return frame.na.drop("any"), frame.where(any_null(frame.columns))


def label_of(prediction: Column, labels: dict[int, str], fallback: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, prediction.cast("int")), F.lit(fallback))


def clipped(prediction: Column) -> Column:
    """Negative forecasts become 0; no forecast stays null."""
    return F.when(prediction.isNotNull(), F.greatest(F.lit(0.0), prediction))


def succeeded(prediction: Column) -> Column:
    return prediction.isNotNull()


def counters(frame: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows read and rows per flag, as one aggregation."""
    return frame.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
