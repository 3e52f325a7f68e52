"""Training frames: null handling, encodings, targets, split."""

from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.functions.statistics import most_frequent
from velobus.operators.ordered import first_by_hash, with_slice

TEST_ONE_IN = 5
SEED = 42
ROWS_PER_TASK = 20_000


def packed(frame: DataFrame, rows: int = ROWS_PER_TASK, most: int | None = None) -> DataFrame:
    """The frame in no more partitions than its rows are worth: a learner visits them in hundreds of
    small jobs, and a task costs more than a thousand rows.

    The rows are dealt out by a shuffle: without one the few tasks that hold them would also do all
    the joins and aggregations the frame comes from. Their order is that of their hashes, so that
    repeated runs see the same. ``most`` partitions are enough unless they would hold more than
    twenty times ``rows``.
    """
    size = frame.count()
    wanted = max(1, -(-size // rows))
    if most:
        wanted = min(wanted, max(most, -(-size // (20 * rows))))
    return frame.repartition(wanted).sortWithinPartitions(F.xxhash64(*frame.columns))


def complete_rows(frame: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns of rows without any null feature."""
    missing = [c for c in features if c not in frame.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return frame.select(*features).na.drop("any")


def split_types(frame: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, text) among the columns; flags count as numeric."""
    kinds = dict(frame.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    return [c for c in columns if c not in text], text


def fill_values(frame: DataFrame, numeric: list[str], text: list[str]) -> dict:
    """The mean per numeric column (0 if all null) and the mode per text column.

    Modes come from counted values, so no task holds all values of a column.
    """
    fills = {}
    if numeric:
        known = [(c, F.col(c).cast("double")) for c in numeric]
        means = [F.avg(F.when(~F.isnan(value), value)).alias(c) for c, value in known]
        row = frame.agg(*means).first()
        fills |= {c: 0.0 if row[c] is None else row[c] for c in numeric}
    if text:
        counted = (
            frame.select(*text)
            .unpivot([], text, "column", "value")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        modes = counted.groupBy("column").agg(most_frequent("value", "n").alias("mode"))
        found = {r["column"]: r["mode"] for r in modes.collect()}
        fills |= {c: found.get(c, "unknown") for c in text}
    return fills


def impute(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Fill numeric nulls (and NaN) with the mean and text nulls with the mode.

    Every column gets a value, so no row is left to drop.
    """
    numeric, text = split_types(frame, columns)
    typed = frame.withColumns({c: F.col(c).cast("double") for c in numeric})
    return typed.fillna(fill_values(frame, numeric, text))


def known_daylight(value: Column) -> Column:
    return F.when(value.isin("yes", "no"), value).otherwise("no")


def known_category(value: Column, labels: list[str]) -> Column:
    """A value the encoder has not seen becomes 'unknown' if that is a class, else the first."""
    fallback = "unknown" if "unknown" in labels else labels[0]
    return F.when(value.isin(labels), value).otherwise(F.lit(fallback))


def encode(frame: DataFrame, column: str, output: str, slices: int | None = None) -> DataFrame:
    """Alphabetical 0-based class number.

    The vocabulary is cut into slices by the first seven bytes of its words, numbered within them,
    and a slice starts where the counts of the slices before it end: one count per slice is all
    that comes together.
    """
    words = frame.select(F.col(column).alias("_word")).where(F.col("_word").isNotNull()).distinct()
    start = F.rpad(F.hex(F.substring(F.encode("_word", "UTF-8"), 1, 7)), 14, "0")
    placed = with_slice(words, F.conv(start, 16, 10).cast("bigint"), "_slice", slices)
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.agg(F.collect_list(F.struct("_slice", "n"))).scalar()
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("_word"))
    ranked = placed.select("_word", "_slice", place.alias("_place")).withColumn("_counts", counts)
    earlier = F.filter("_counts", lambda c: c["_slice"] < F.col("_slice"))
    begin = F.aggregate(earlier, F.lit(0).cast("bigint"), lambda n, c: n + c["n"])
    numbered = ranked.select("_word", (begin + F.col("_place") - 1).cast("int").alias(output))
    return frame.join(numbered, frame[column] == numbered["_word"], "left").drop("_word")


def standardize(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    stats = frame.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first()

    def scaled(c: str) -> Column:
        mean, std = stats[f"mean_{c}"], stats[f"std_{c}"]
        return (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)

    return frame.withColumns({c: scaled(c) for c in columns})


def bike_targets(frame: DataFrame) -> DataFrame:
    """low_bikes, bike_level and the regression target of a station row."""
    bikes, capacity = F.col("bikes_available"), F.col("capacity")
    ratio = F.when(capacity > 0, bikes / F.nullif(capacity, F.lit(0))).otherwise(0.0)
    low = (capacity > 0) & (bikes < capacity * 0.25)
    level = F.when(ratio == 0, 0).when(ratio <= 0.33, 1).when(ratio <= 0.66, 2).otherwise(3)
    return frame.withColumns(
        {
            "low_bikes": F.when(low, 1).otherwise(0),
            "bike_level": level,
            "bikes_target": bikes.cast("double"),
        }
    )


def bus_targets(frame: DataFrame) -> DataFrame:
    """is_late, delay_category and the regression target of a trip row."""
    delay = F.col("average_delay_seconds")
    return frame.withColumns(
        {
            "is_late": F.when(delay > 0, 1).otherwise(0),
            "delay_category": F.when(delay <= 0, 0).when(delay <= 300, 1).otherwise(2),
            "delay_target": delay.cast("double"),
        }
    )


def split(
    frame: DataFrame, id_col: str, label: str | None = None, seed: int = SEED
) -> DataFrame:
    """Mark a fifth of the rows as test, exactly and repeatably; per class when stratified."""
    # ceil(size / 5) in whole numbers
    quota = F.floor((F.col("size") + TEST_ONE_IN - 1) / TEST_ONE_IN)
    by = [label] if label else []
    return first_by_hash(frame, id_col, by, str(seed), quota, "is_test", few_groups=True)


class KnownCategory(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Pipeline stage for :func:`known_category`, kept with the model it was trained with."""

    labels = Param(Params._dummy(), "labels", "known classes", TypeConverters.toListString)

    def __init__(self, inputCol=None, outputCol=None, labels=None):
        super().__init__()
        self._set(**{
            k: v
            for k, v in {"inputCol": inputCol, "outputCol": outputCol, "labels": labels}.items()
            if v is not None
        })

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = known_category(F.col(self.getInputCol()), self.getOrDefault(self.labels))
        return dataset.withColumn(self.getOutputCol(), value)


def feature_pipeline(
    frame: DataFrame, features: list[str], scaled: str = "features"
) -> PipelineModel:
    """Fit encoding, assembling and scaling of the features; used alike for fit and score."""
    numeric, text = split_types(frame, features)
    known = [f"{c}_known" for c in text]
    encoded = [f"{c}_encoded" for c in text]
    stages = []
    if text:
        indexer = StringIndexer(
            inputCols=known, outputCols=encoded, stringOrderType="alphabetAsc",
            handleInvalid="error",
        ).fit(frame.withColumns(dict(zip(known, map(F.col, text)))))
        stages = [
            KnownCategory(c, k, list(labels))
            for c, k, labels in zip(text, known, indexer.labelsArray)
        ] + [indexer]
    stages.append(
        VectorAssembler(
            inputCols=numeric + encoded, outputCol="raw_features", handleInvalid="error"
        )
    )
    assembled = PipelineModel(stages=stages).transform(frame)
    scaler = StandardScaler(inputCol="raw_features", outputCol=scaled, withMean=True, withStd=True)
    return PipelineModel(stages=[*stages, scaler.fit(assembled)])


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
