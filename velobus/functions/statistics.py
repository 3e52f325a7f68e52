"""Aggregate expressions shared by the analytic questions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null without variation."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(varies, F.try_divide(F.covar_pop(px, py), spread))


def success_rate(flag: Column) -> Column:
    """Share of true flags among all rows in percent; 0 without rows."""
    share = F.try_divide(F.count_if(flag) * 100.0, F.count(F.lit(1)))
    return F.coalesce(share, F.lit(0.0))


def band(value: Column, limit: float, high: Column, low: Column, middle: Column) -> Column:
    """Three-way verdict around plus and minus the limit; null stays null."""
    return F.when(value > limit, high).when(value < -limit, low).when(value.isNotNull(), middle)


def most_frequent(value: str, count: str) -> Column:
    """The value with the highest count, the smaller value on ties, from counted rows."""
    return F.min_by(F.col(value), F.struct(-F.col(count), F.col(value)))
