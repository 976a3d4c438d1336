"""Null, tie and rounding rules decided once for every report.

The original pipeline ran on pandas; these helpers pin down how each of its
behaviours is expressed with built-in Spark functions so every query agrees:

* grouping drops NULL keys (``nonnull``)
* ``sum`` of an all-NULL group is 0 (``sum0``)
* money is summed unrounded and the total rounded to the cent (``money_sum``), so it does not
  depend on partitioning or summation order
* standard deviation is the sample form (NULL for one row)
* medians / quantiles are exact with linear interpolation (``percentile``)
* ties in mode / arg-max resolve to the smallest label
* division by zero gives NULL (``ratio``)
* weekday numbers are Monday=0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonnull(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose grouping keys are NULL (pandas groupby default)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else (cond & c)
    return df if cond is None else df.where(cond)


def sum0(c) -> Column:
    return F.coalesce(F.sum(col(c)), F.lit(0))


def money_sum(c) -> Column:
    """Sum of the unrounded values, to the cent: rounding once, after the sum, absorbs
    the order in which partitions are added."""
    return F.round(F.coalesce(F.sum(col(c)), F.lit(0.0)), 2)


def rnd(c, n: int = 6) -> Column:
    return F.round(col(c), n)


def ratio(num, den) -> Column:
    """num/den with NULL on a zero or NULL denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num, den) -> Column:
    return ratio(num, den) * F.lit(100.0)


def rate(flag) -> Column:
    """Mean of a 0/1 flag as a percentage."""
    return F.avg(col(flag).cast("double")) * F.lit(100.0)


def nunique(c) -> Column:
    return F.countDistinct(col(c))


def mode_det(c) -> Column:
    """Most frequent non-NULL value; smallest value on a tie."""
    return F.mode(col(c), True)


def first_nonnull(value, *order) -> Column:
    """Value of the earliest row (by ``order``) among rows where value is not NULL."""
    v = col(value)
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*[col(o) for o in order])))


def last_nonnull(value, *order) -> Column:
    v = col(value)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*[col(o) for o in order])))


def weekday0(ts) -> Column:
    """Monday=0 … Sunday=6."""
    return F.weekday(col(ts))


def day_name(ts) -> Column:
    return F.date_format(col(ts), "EEEE")


def month_name(ts) -> Column:
    return F.date_format(col(ts), "MMMM")


def is_weekend(ts) -> Column:
    return F.weekday(col(ts)) >= 5


def minutes_between(start, end) -> Column:
    """(end - start) in minutes as double, microsecond precision."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(60_000_000.0)


def floor_days(later, earlier) -> Column:
    """Whole days, floored: (later - earlier) // 1 day."""
    micros = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return F.floor(micros / F.lit(86_400_000_000.0))


def cut(c, edges: list[float], labels: list[str]) -> Column:
    """Right-closed, left-open bins; values outside (edges[0], edges[-1]] -> NULL."""
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# Calendar dimension: fixed values (Monday-first week, as pandas orders it).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
