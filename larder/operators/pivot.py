"""Pivot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.semantics import nonnull


def pivot_sum(df: DataFrame, row_key: str, col_key: str, values: list, measure: str,
              fill=0) -> DataFrame:
    """row_key x col_key matrix of sum(measure); missing cells = ``fill``.

    ``values`` must be known up front (from a dimension table): Spark then
    plans the pivot as one aggregate of conditional sums, with no extra job to
    discover the distinct values and a fixed output schema.
    """
    g = nonnull(df, row_key).groupBy(row_key).pivot(col_key, values).agg(F.sum(measure))
    return g.fillna(fill, subset=[str(v) for v in values])


def pivot_mean(df: DataFrame, row_key: str, col_key: str, values: list, measure: str) -> DataFrame:
    return nonnull(df, row_key).groupBy(row_key).pivot(col_key, values).agg(F.avg(measure))
