"""Ranks and shares over all keys without a window over all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.stages import written

c = F.col


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in ``order``, which tells all rows apart.

    The rows are dealt to ranges of the order; ranks run inside a range, and the sizes of the
    ranges before it, one row a range, are added.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(c("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_r", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = rows.withColumn(name, inside).join(sizes, c("_range") == c("_r"))
    return out.withColumn(name, (c(name) + c("_before")).cast("int")).drop("_range", "_r", "_before")


def top_shares(grouped: DataFrame, value: str, key: str, sizes: list[int]) -> DataFrame:
    """One row: percent of the total that the largest keys hold (``top<n>``), and the number of ``keys``.

    The largest keys come from a top-k of the grouped rows; ties go by key.
    """
    top = grouped.orderBy(c(value).desc(), key).limit(max(sizes)).withColumn("_place", F.row_number().over(Window.orderBy(c(value).desc(), key)))
    total = grouped.agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("keys"))
    share = c(value) * 100.0 / c("_total")
    return top.crossJoin(F.broadcast(total)).groupBy("keys").agg(*[F.sum(F.when(c("_place") <= n, share)).alias(f"top{n}") for n in sizes])
