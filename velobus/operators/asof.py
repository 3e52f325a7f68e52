"""Nearest-in-time join: every fact gets the reading closest to it, earlier or later."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.operators.ordered import with_slice
from velobus.session import stored_copy


def micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))


def nearest_times(facts: DataFrame, readings: DataFrame, slices: int | None = None) -> DataFrame:
    """Map every distinct fact time to the nearest reading time; both are micros in column "t".

    Ties go to the earlier reading. Works on distinct times only, so a poll that stamps millions
    of facts alike counts once, and sorts inside equi-depth slices of the merged timeline.
    """
    # One mark per time: 1 = a fact asks, 2 = a reading is there, 3 = both.
    timeline = (
        facts.select("t", F.lit(1).alias("bit"))
        .unionByName(readings.select("t", F.lit(2).alias("bit")))
        .where(F.col("t").isNotNull())
        .groupBy("t")
        .agg(F.bit_or("bit").alias("mark"))
    )
    # The borders are taken over (t, mark) too, so all three uses read one shuffled timeline.
    marked = timeline.where(F.col("mark") > 0)
    sliced = with_slice(marked, F.col("t"), "slice", slices)
    read = F.when(F.col("mark") >= 2, F.col("t"))

    inside = Window.partitionBy("slice")
    near = sliced.select(
        "slice",
        "t",
        "mark",
        F.last(read, ignorenulls=True).over(inside.orderBy("t")).alias("before"),
        F.last(read, ignorenulls=True).over(inside.orderBy(F.desc("t"))).alias("after"),
    ).where(F.col("mark") != 2)

    # One row per slice: what is known left and right of it.
    edges = sliced.groupBy("slice").agg(F.max(read).alias("hi"), F.min(read).alias("lo"))
    order = Window.orderBy("slice")
    edges = edges.select(
        F.col("slice").alias("edge"),
        F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
    )
    # One row per slice, and one slice per shuffle partition: safe to broadcast at every data size.
    joined = near.join(F.broadcast(edges), near["slice"] == edges["edge"], "left")
    before = F.coalesce("before", "left")
    after = F.coalesce("after", "right")
    nearest = F.when(
        after.isNull() | (F.col("t") - before <= after - F.col("t")), before
    ).otherwise(after)
    return joined.select("t", nearest.alias("read"))


def nearest_join(
    facts: DataFrame,
    readings: DataFrame,
    fact_time: str,
    reading_time: str,
    columns: list[str],
    reading_order: str | None = None,
    known_by: Column | None = None,
    slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Left nearest as-of join without key or tolerance.

    Reading columns replace fact columns of the same name. Of several readings with one time the
    one with the smallest ``reading_order`` is used. ``known_by`` drops readings taken later than
    the given instant. With no reading at all the columns are null.

    The facts meet a table of one row per distinct fact time. ``stored`` writes that table to the
    shared folder first: the planner then knows its size, and where polls stamp many facts alike
    it is broadcast and the facts are never shuffled.
    """
    if known_by is not None:
        readings = readings.where(F.col(reading_time).cast("timestamp") <= known_by)
    facts = facts.drop(*[c for c in columns if c in facts.columns and c != fact_time])
    facts = facts.withColumn("_t", micros(F.col(fact_time)))
    wanted = F.struct(*columns)
    by_time = (
        readings.withColumn("_r", micros(F.col(reading_time)))
        .where(F.col("_r").isNotNull())
        .groupBy("_r")
        .agg(F.min_by(wanted, F.col(reading_order) if reading_order else wanted).alias("_env"))
    )
    times = nearest_times(
        facts.select(F.col("_t").alias("t")), by_time.select(F.col("_r").alias("t")), slices
    )
    attached = times.join(by_time, times["read"] == by_time["_r"], "left").select(
        F.col("t").alias("_at"), "_env"
    )
    if stored:
        attached = stored_copy(attached, "nearest")
    joined = facts.join(attached, facts["_t"] == attached["_at"], "left")
    kept = [c for c in facts.columns if c != "_t"]
    return joined.select(*kept, *[F.col("_env")[c].alias(c) for c in columns])
