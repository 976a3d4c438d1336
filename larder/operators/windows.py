"""Window operators.

Fact-level windows are always partitioned by a key. Unpartitioned windows
(moving averages, ranks, date segments) only ever run on small aggregates
such as one row per day or per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# pandas time-based rolling '7D' covers (t - 7 days, t]. A RANGE frame is
# closed at both ends, so the lower bound sits one microsecond inside.
_OPEN_LOWER = {
    "7D": "INTERVAL '6 23:59:59.999999' DAY TO SECOND",
    "30D": "INTERVAL '29 23:59:59.999999' DAY TO SECOND",
}


def centered_moving_average(df: DataFrame, order_col: str, value: str, n: int, name: str) -> DataFrame:
    """Centred n-row mean that is NULL unless the frame holds n rows."""
    half = n // 2
    w = Window.orderBy(order_col).rowsBetween(-half, half)
    return df.withColumn(
        name, F.when(F.count(value).over(w) == n, F.round(F.avg(value).over(w), 6)))


def rolling_time_stats(df: DataFrame, key: str, ts: str, value: str, window: str,
                       prefix: str | None = None) -> DataFrame:
    """Per-row mean, median, std (NULL->0) and count of ``value`` over the
    trailing time window ``(ts - window, ts]`` within ``key`` (W01).

    Rows with NULL key or NULL timestamp get NULL statistics and count 0,
    like the pandas pipeline, which skips them when rolling. Rows with equal
    timestamps are peers and share one frame (deterministic).
    """
    prefix = prefix or key
    lower = _OPEN_LOWER[window]
    frame = f"(PARTITION BY {key} ORDER BY {ts} RANGE BETWEEN {lower} PRECEDING AND CURRENT ROW)"
    valid = c(key).isNotNull() & c(ts).isNotNull()

    def over(expr: str) -> Column:
        return F.expr(f"{expr} OVER {frame}")

    return df.withColumns({
        f"{prefix}_mean_{window}": F.when(valid, over(f"avg({value})")),
        f"{prefix}_median_{window}": F.when(valid, over(f"percentile({value}, 0.5)")),
        f"{prefix}_std_{window}": F.when(valid, F.coalesce(over(f"stddev_samp({value})"), F.lit(0.0))),
        f"{prefix}_count_{window}": F.when(valid, over(f"count({value})")).otherwise(F.lit(0)),
    })


def group_zscore(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean/std of ``value`` over all rows of ``key`` and the row z-score.

    Expressed as an aggregate joined back on the key rather than an
    unbounded window: the aggregate is combined map-side, so a key holding a
    third of all rows is still reduced in parallel, and the join back is a
    broadcast only if AQE measures the per-key table as small.
    """
    stats = (df.where(c(key).isNotNull()).groupBy(key)
               .agg(F.avg(value).alias(f"{key}_mean"), F.stddev_samp(value).alias(f"{key}_std")))
    out = df.join(stats, key, "left")
    return out.withColumn(
        f"{key}_zscore", (c(value) - c(f"{key}_mean")) / F.nullif(c(f"{key}_std"), F.lit(0.0)))


def date_segments(dates: DataFrame, date_col: str, n: int, name: str = "segment") -> DataFrame:
    """Split distinct dates into n contiguous near-equal parts.

    ``ntile`` gives the first (count % n) tiles one extra member, the same
    remainder rule as numpy's array_split. Runs on one row per date.
    """
    return dates.withColumn(name, F.ntile(n).over(Window.orderBy(c(date_col).asc_nulls_last())))
