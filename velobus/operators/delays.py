"""Delay statistics of a trip: from a nested stop list, and from flat stop rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velobus.operators.ordered import with_slice
from velobus.session import shuffle_width


def trend_label(rises: Column, falls: Column) -> Column:
    """A direction wins when it occurs more than one and a half times as often as the other."""
    return (
        F.when(rises > falls * 1.5, "increasing")
        .when(falls > rises * 1.5, "decreasing")
        .otherwise("stable")
    )


def _whole_seconds(kind: T.DataType) -> None:
    """Delays are whole seconds: the variance is summed in integers, which would cut fractions."""
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"delays must be whole seconds, not {kind.simpleString()}")


def _exact_variance(n: Column, total: Column, squares: Column) -> Column:
    """Sample variance of whole-second delays from integer sums: exact, and the same for every
    partitioning. Null below two values."""
    wide = "decimal(38,0)"
    spread = n.cast("decimal(18,0)") * squares.cast("decimal(19,0)") - (
        total.cast("decimal(19,0)") * total.cast("decimal(18,0)")
    )
    pairs = n.cast("bigint") * (n.cast("bigint") - 1)
    return F.when(n > 1, spread.cast(wide).cast("double") / pairs.cast("double"))


def _statistics(
    stops: Column,
    known: Column,
    mean: Column,
    high: Column,
    low: Column,
    variance: Column,
    on_time: Column,
    early: Column,
    late: Column,
    mean_late: Column,
    mean_early: Column,
    trend: Column | None,
) -> list[Column]:
    """The delay columns from their raw aggregates; nulls become the empty-list values."""
    variance = F.coalesce(variance, F.lit(0.0))
    zero = F.lit(0.0)
    return [
        stops.cast("int").alias("stops_count"),
        F.coalesce(F.round(mean, 2), zero).alias("avg_delay"),
        F.coalesce(high, F.lit(0)).alias("max_delay"),
        F.coalesce(low, F.lit(0)).alias("min_delay"),
        F.round(variance, 2).alias("delay_variance"),
        F.round(F.sqrt(variance), 2).alias("delay_std_dev"),
        F.coalesce(high - low, F.lit(0)).alias("delay_range"),
        on_time.cast("int").alias("on_time_stops"),
        early.cast("int").alias("early_stops"),
        late.cast("int").alias("late_stops"),
        *([] if trend is None else [F.coalesce(trend, F.lit("stable")).alias("delay_trend")]),
        F.round(1 / (1 + variance), 3).alias("consistency_score"),
        F.coalesce(F.round(F.try_divide(on_time, known), 3), zero).alias("punctuality_ratio"),
        F.coalesce(F.round(mean_late, 2), zero).alias("avg_positive_delay"),
        F.coalesce(F.round(mean_early, 2), zero).alias("avg_negative_delay"),
    ]


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, d: acc + d)
    return F.try_divide(total, F.size(values))


def with_delay_statistics(messages: DataFrame, stops: str = "estimated_stops") -> DataFrame:
    """Replace the nested stop list of each message by its delay statistics; no shuffle."""
    _whole_seconds(messages.schema[stops].dataType.elementType["delay"].dataType)
    listed = F.coalesce(F.col(stops), F.array().cast(messages.schema[stops].dataType))
    delays = F.filter(F.transform(listed, lambda s: s["delay"]), lambda d: d.isNotNull())
    frame = messages.withColumn("_stops", F.size(listed)).withColumn("_d", delays)
    d = F.col("_d")
    frame = frame.withColumn("_mean", _mean(d))
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(d, zero, lambda acc, v: acc + v)
    squares = F.aggregate(
        d, zero, lambda acc, v: acc + v.cast("bigint") * v.cast("bigint")
    )
    # Deltas between neighbours; an empty or one-element list has none.
    deltas = F.zip_with(
        F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))),
        F.slice(d, F.lit(1), F.greatest(F.size(d) - 1, F.lit(0))),
        lambda after, before: after - before,
    )
    frame = frame.withColumn("_delta", deltas)
    late, early = F.filter(d, lambda v: v > 0), F.filter(d, lambda v: v < 0)
    n = F.size(d)
    columns = _statistics(
        stops=F.col("_stops"),
        known=n,
        mean=F.col("_mean"),
        high=F.array_max(d),
        low=F.array_min(d),
        variance=_exact_variance(n, total, squares),
        on_time=F.size(F.filter(d, lambda v: v == 0)),
        early=F.size(early),
        late=F.size(late),
        mean_late=_mean(late),
        mean_early=_mean(early),
        trend=trend_label(
            F.size(F.filter("_delta", lambda v: v > 0)), F.size(F.filter("_delta", lambda v: v < 0))
        ),
    )
    kept = [c for c in messages.columns if c != stops]
    return frame.select(*kept, *columns)


def _ordinal(frame: DataFrame, column: str) -> Column:
    """A whole number that grows with the column."""
    kind = frame.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.floor(F.col(column)).cast("bigint")


def delay_trend(
    stops: DataFrame,
    keys: list[str],
    position: list[str],
    delay: str = "delay",
    slices: int | None = None,
) -> DataFrame:
    """Rises, falls and the trend label per trip, from flat stop rows.

    Rows of a trip that share position and delay cannot change the trend; merging them first
    (map-side) bounds what a trip can bring into the ordered step by its distinct positions.

    A stretch of a trip is summed up by its first and last delay, its rises and its falls, and two
    stretches that follow each other are joined by comparing the last with the first. A trip that
    holds more than its share of all rows is cut into stretches by its first position column, so no
    task sees it whole; the others are one stretch each.
    """
    width = slices or shuffle_width(stops.sparkSession)
    facts = stops.where(F.col(delay).isNotNull())
    known = facts.groupBy(*keys, *position, delay).agg(F.count(F.lit(1)).alias("_copies"))
    n = F.count(F.lit(1))
    # At most 4 * width trips can each hold more than that part of all rows.
    large = facts.groupBy(*[F.col(k).alias(f"_on_{k}") for k in keys]).agg(n.alias("_n"))
    large = large.where(F.col("_n") * 4 * width > facts.agg(n).scalar())
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    marked = known.join(F.broadcast(large), same, "left").withColumn("_at", _ordinal(known, position[0]))
    cut = with_slice(marked, F.col("_at"), "_slice", width, marked.where("_n IS NOT NULL"))
    cut = cut.withColumn("_slice", F.when(F.col("_n").isNull(), -1).otherwise(F.col("_slice")))

    order = [*position, delay]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    step = F.col("_step")
    stretches = (
        cut.withColumn("_step", F.col(delay) - F.lag(delay).over(inside))
        .groupBy(*keys, "_slice")
        .agg(
            F.count_if(step > 0).alias("_up"),
            F.count_if(step < 0).alias("_down"),
            F.min_by(delay, F.struct(*order)).alias("_first"),
            F.max_by(delay, F.struct(*order)).alias("_final"),
        )
    )
    # One row per trip, or per slice of a large one.
    across = Window.partitionBy(*keys).orderBy("_slice")
    joint = stretches.withColumn("_step", F.col("_first") - F.lag("_final").over(across))
    return (
        joint.groupBy(*keys)
        .agg(
            (F.sum("_up") + F.count_if(step > 0)).alias("rises"),
            (F.sum("_down") + F.count_if(step < 0)).alias("falls"),
        )
        .withColumn("delay_trend", trend_label(F.col("rises"), F.col("falls")))
    )


def delay_statistics(
    stops: DataFrame,
    keys: list[str],
    delay: str = "delay",
    position: list[str] | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """The statistics from flat stop rows: one hash aggregation, partial before the shuffle.

    Without ``position`` the trend column is left out. ``extra`` adds further aggregates.
    """
    _whole_seconds(stops.schema[delay].dataType)
    d = F.col(delay)
    raw = stops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_stops"),
        F.count(d).alias("_known"),
        F.avg(d).alias("_mean"),
        F.max(d).alias("_high"),
        F.min(d).alias("_low"),
        F.sum(d.cast("bigint")).alias("_total"),
        F.sum(d.cast("bigint") * d.cast("bigint")).alias("_squares"),
        F.count_if(d == 0).alias("_on_time"),
        F.count_if(d < 0).alias("_early"),
        F.count_if(d > 0).alias("_late"),
        F.avg(F.when(d > 0, d)).alias("_mean_late"),
        F.avg(F.when(d < 0, d)).alias("_mean_early"),
        *(extra or []),
    )
    if position:
        trend = delay_trend(stops, keys, position, delay).select(*keys, "delay_trend")
        raw = raw.join(trend, keys, "left")
    raw = raw.withColumn(
        "_variance", _exact_variance(F.col("_known"), F.col("_total"), F.col("_squares"))
    )
    columns = _statistics(
        *[
            F.col(c)
            for c in (
                "_stops", "_known", "_mean", "_high", "_low", "_variance", "_on_time", "_early",
                "_late", "_mean_late", "_mean_early",
            )
        ],
        trend=F.col("delay_trend") if position else None,
    )
    kept = [c for c in raw.columns if not c.startswith("_") and c != "delay_trend"]
    return raw.select(*kept, *columns)
