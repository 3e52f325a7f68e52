"""Order-dependent operators that never put one key's whole history into one task.

Ordered data is cut into equi-depth slices. Every slice is handled on its own, and what crosses a
slice border travels in a small table with one row per (key, slice).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.session import shuffle_width

# Hexadecimal digits of a hash by which first_by_hash() narrows its search, step by step.
PREFIXES = (4, 8)


def with_slice(
    frame: DataFrame,
    position: Column,
    output: str,
    slices: int | None = None,
    over: DataFrame | None = None,
) -> DataFrame:
    """Add the number of the equi-depth slice a row's position (a BIGINT) falls into.

    The borders are quantiles of the position over the frame (or over ``over``): one narrow scan,
    one row of result.
    """
    slices = slices or shuffle_width(frame.sparkSession)
    fractions = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    quantiles = F.percentile_approx(position, fractions, F.lit(10 * slices))
    borders = (frame if over is None else over).select(quantiles).scalar()
    steps = [1 << i for i in reversed(range((slices - 1).bit_length()))]

    # Binary search over the borders: each step either jumps over a run of smaller borders or not.
    def jump(found, step):
        border = F.get(F.col("_borders"), found + step - 1)
        return F.when(border <= F.col("_position"), found + step).otherwise(found)

    placed = frame.withColumns({"_borders": borders, "_position": position})
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), jump)
    return placed.withColumn(output, found).drop("_borders", "_position")


def previous_value(
    frame: DataFrame,
    keys: list[str],
    position: Column,
    tie_break: list[str],
    value: str,
    output: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the value of the preceding row of the same key (null for the first row).

    The lag runs inside (key, slice); the first row of a slice takes the last value of the key's
    nearest earlier slice. A key holding a third of all rows is spread over all slices. A row with
    a null key belongs to no series and gets null.
    """
    part = with_slice(frame, position, "_slice", slices)
    order = F.struct(position.alias("_p"), *[F.col(c) for c in tie_break])
    last = part.groupBy(*keys, "_slice").agg(F.max_by(F.struct(value), order).alias("_last"))
    # One row per (key, slice): at most as many rows per key as there are slices.
    across = Window.partitionBy(*keys).orderBy("_slice")
    on = [*keys, "_slice"]
    carry = last.select(
        *[F.col(c).alias(f"_on_{c}") for c in on], F.lag("_last").over(across).alias("_carry")
    ).where(F.col("_carry").isNotNull())

    # Plain equality keeps the partitioning of the lag, so the big side is shuffled once.
    inside = Window.partitionBy(*on).orderBy(order)
    lagged = part.withColumn("_lag", F.lag(F.struct(value)).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_on_{c}") for c in on])
    joined = lagged.join(carry, same, "left")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    before = F.when(known, F.coalesce("_lag", "_carry")[value])
    return joined.select(*frame.columns, before.alias(output))


def first_by_hash(
    frame: DataFrame,
    id_col: str,
    by: list[str],
    seed: str,
    quota: Column,
    output: str,
    few_groups: bool = False,
) -> DataFrame:
    """Flag the first rows of each group in the order of md5(seed, id).

    ``quota`` is the number of rows to flag, an expression over "size", the group's row count; rows
    sharing an id are flagged together. md5 spreads the ids evenly over its prefixes: counting per
    (group, prefix) shows in which one the quota ends, and that one is counted by longer prefixes in
    turn. Every count has at most 65536 rows per group, whatever the number of rows. Only the last
    prefix, one in 16 ** 8 ids, is ranked, and the last flagged id becomes the group's limit. The
    rows themselves are compared with one limit per group (the whole frame without ``by``). With
    ``few_groups`` (class labels) the limits are broadcast and no row is shuffled.
    """
    small = F.broadcast if few_groups else (lambda side: side)
    md5 = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    hashed = frame.withColumn("_md5", md5)
    narrow = hashed.select(*by, id_col, "_md5")
    first, *longer = [F.substring("_md5", 1, digits) for digits in PREFIXES]
    counted = narrow.groupBy(*by, first.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    sized = counted.withColumn("size", F.sum("_n").over(Window.partitionBy(*by)))
    cuts = _cut(sized.withColumn("_wanted", quota), by)
    inside = narrow.withColumn("_prefix", first).join(small(cuts), _same([*by, "_prefix"]))
    for prefix in longer:
        inside = inside.select(*by, id_col, "_md5", "_place")
        counted = inside.groupBy(*by, prefix.alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_n"), F.max("_place").alias("_wanted")
        )
        cuts = _cut(counted, by)
        inside = inside.drop("_place").withColumn("_prefix", prefix)
        inside = inside.join(small(cuts), _same([*by, "_prefix"]))
    # Copies of an id count as one row here, however many there are.
    ids = (
        inside.groupBy(*by, "_md5", id_col, "_place")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    order = Window.partitionBy(*by).orderBy("_md5", id_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    limits = (
        ids.withColumn("_rank", F.sum("_copies").over(order))
        .where(
            (F.col("_rank") >= F.col("_place"))
            & (F.col("_rank") - F.col("_copies") < F.col("_place"))
        )
        .select(
            *[F.col(c).alias(f"_on_{c}") for c in by],
            F.struct("_md5", F.col(id_col).alias("_id")).alias("_limit"),
        )
    )
    key = F.struct(F.col("_md5"), F.col(id_col).alias("_id"))
    if not by:
        limited = hashed.withColumn("_limit", limits.select("_limit").scalar())
    else:
        limited = hashed.join(small(limits), _same(by), "left")
    flag = F.coalesce(key <= F.col("_limit"), F.lit(False))
    return limited.select(*frame.columns, flag.alias(output))


def _cut(counted: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (group, _prefix, _n, _wanted): the prefix in which the group's wanted row lies, and
    the row's place in there."""
    order = Window.partitionBy(*by).orderBy("_prefix")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("_upto") - F.col("_n")
    here = (before < F.col("_wanted")) & (F.col("_upto") >= F.col("_wanted"))
    return counted.withColumn("_upto", upto).where(here).select(
        *[F.col(c).alias(f"_on_{c}") for c in by],
        F.col("_prefix").alias("_on__prefix"),
        (F.col("_wanted") - before).alias("_place"),
    )


def _same(columns: list[str]) -> Column:
    """Null-safe equality of columns with their "_on_" copies; for small right sides."""
    return reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in columns]
    )
