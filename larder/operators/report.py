"""Grouped report operator and small-aggregate helpers.

``report`` is the universal group-by verb of the original pipeline
(``groupby(k).agg({...})`` then sort and head). On Spark it becomes one
partial + final hash aggregate: rows are pre-aggregated map-side, so only one
row per key and partition crosses the shuffle, and a hot key costs no more
than any other. Ordering and limits apply to the (small) aggregate only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.semantics import nonnull


def report(df: DataFrame, keys, aggs: list[Column], having: Column | None = None,
           order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """``keys -> aggs ; having ; order ; limit`` with pandas NULL-key semantics."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    g = nonnull(df, *keys).groupBy(*keys).agg(*aggs)
    if having is not None:
        g = g.where(having)
    if order:
        # Keys always end the sort so a limit is deterministic on ties.
        g = g.orderBy(*order, *[F.col(k).asc() for k in keys])
    if limit is not None:
        g = g.limit(limit)
    return g


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Top-k of an aggregate: planned as TakeOrderedAndProject (no global sort)."""
    return df.orderBy(*order).limit(k)


def with_share(df: DataFrame, value: str, name: str, scale: float = 100.0) -> DataFrame:
    """value / grand total * scale. Runs on an aggregate, so the unpartitioned
    window holds one row per group, never fact rows."""
    total = F.sum(F.col(value)).over(Window.partitionBy())
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), total) * F.lit(scale))


def unpivot_metrics(df: DataFrame, section: str) -> DataFrame:
    """One-row metrics frame -> long ``(section, metric, value)`` rows."""
    cols = df.columns
    return (df.select(*[F.col(x).cast("double").alias(x) for x in cols])
              .unpivot([], cols, "metric", "value")
              .select(F.lit(section).alias("section"), "metric", "value"))
