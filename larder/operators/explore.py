"""Filters, describes and correlation over any table: F05-F07, A07, A26, A37."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.semantics import nonnull, rnd

c = F.col


def in_list(df: DataFrame, key: str, values: list) -> DataFrame:
    """F05. An empty selection keeps everything, as an untouched filter does."""
    return df.where(c(key).isin(list(values))) if values else df


def date_range(df: DataFrame, ts: str, first: date | None, last: date | None) -> DataFrame:
    """whole calendar days, both ends included; a plain range on the column, so it reaches the scan."""
    if first is not None:
        df = df.where(c(ts) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        df = df.where(c(ts) < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    return df


def select_rows(df: DataFrame, keys: dict[str, list], ts: str | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """key lists and a date range together."""
    for k, v in keys.items():
        df = in_list(df, k, v)
    return date_range(df, ts, first, last) if ts else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe_all(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row a column. Numbers: count, mean, std, min, max; texts: count, distinct, top, freq.

    One pass for the numbers. Texts are counted by (column, value) first, so what is
    compared afterwards is one row a distinct value, combined on the map side.
    """
    none = F.lit(None)
    out = df.agg(*[F.struct(F.lit(n).alias("column_name"), F.count(n).alias("n"), rnd(F.avg(n)).alias("mean"), rnd(F.stddev_samp(n)).alias("std"),
                            F.min(c(n).cast("double")).alias("min"), F.max(c(n).cast("double")).alias("max")).alias(f"s{i}") for i, n in enumerate(numeric)])
    out = out.select(F.explode(F.array(*[c(f"s{i}") for i in range(len(numeric))])).alias("s")).select(
        "s.*", none.cast("bigint").alias("distinct_values"), none.cast("string").alias("top"), none.cast("bigint").alias("freq"))
    if not text:
        return out
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("column_name"), c(t).cast("string").alias("v")) for t in text])).alias("x")).select("x.*")
    counts = vals.where(c("v").isNotNull()).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("k"))
    best = counts.groupBy("column_name").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_values"),
                                             F.min(F.struct((-c("k")).alias("k"), c("v").alias("v"))).alias("b"))
    best = best.select("column_name", "n", *[none.cast("double").alias(x) for x in ("mean", "std", "min", "max")], "distinct_values",
                       c("b.v").alias("top"), (-c("b.k")).alias("freq"))
    return out.unionByName(best)


def describe_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean, median, std and count of every column by key."""
    return nonnull(df, key).groupBy(key).agg(*[x for n in columns for x in (
        rnd(F.avg(n)).alias(f"{n}_mean"), rnd(F.median(n)).alias(f"{n}_median"), rnd(F.stddev_samp(n)).alias(f"{n}_std"), F.count(n).alias(f"{n}_count"))])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_x, column_y, corr) of all pairs, each over the rows where both are known; one pass."""
    pairs = list(combinations(columns, 2))
    both = lambda x, y: c(x).isNotNull() & c(y).isNotNull()
    one = df.agg(*[rnd(F.corr(F.when(both(x, y), c(x).cast("double")), F.when(both(x, y), c(y).cast("double"))), 6).alias(f"p{i}") for i, (x, y) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("column_x"), F.lit(y).alias("column_y"), c(f"p{i}").alias("corr")) for i, (x, y) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
