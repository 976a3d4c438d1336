"""Descriptive statistics: describe (A06), histogram (A42), box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.semantics import nonnull, rnd
from larder.operators.quantiles import exact_quantiles

c = F.col


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, exact quartiles, max of all rows.

    ``DataFrame.summary`` uses approximate percentiles; these are exact, with linear
    interpolation, matching pandas, and no task holds all values.
    """
    g = df.agg(
        F.count(value).alias("count"), rnd(F.avg(value)).alias("mean"),
        rnd(F.stddev_samp(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df, [], value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"]).drop("n")
    # One row each; without values the quartiles have none, and are null.
    return g.join(F.broadcast(q), F.lit(True), "left").select(
        "count", "mean", "std", "min", rnd("p25").alias("p25"), rnd("p50").alias("p50"), rnd("p75").alias("p75"), "max")


def histogram(df: DataFrame, value: str, bins: int, key: str | None = None) -> DataFrame:
    """Equal-width histogram between min and max (numpy/matplotlib rule).

    Bin i covers [lo + i*w, lo + (i+1)*w); the last bin is closed on the
    right so the maximum lands in it. Bounds come from a one-row aggregate
    (broadcast: one row by construction); counting is a partial+final
    aggregate over (bin), so no value list is ever gathered. Empty bins are
    emitted by joining against the bin-number range.
    """
    spark = df.sparkSession
    x = c(value)
    base = df.where(x.isNotNull())
    bounds = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (c("hi") - c("lo")) / F.lit(float(bins))
    b = F.when(c("hi") == c("lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - c("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = (base.crossJoin(F.broadcast(bounds)).select(b.alias("bin"))
                   .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    dim = spark.range(bins).select(c("id").cast("int").alias("bin")).crossJoin(F.broadcast(bounds))
    out = dim.join(counted, "bin", "left").select(
        "bin",
        rnd(c("lo") + c("bin") * width).alias("bin_start"),
        rnd(c("lo") + (c("bin") + 1) * width).alias("bin_end"),
        F.coalesce(c("count"), F.lit(0)).cast("bigint").alias("count"))
    return out


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: quartiles, 1.5*IQR whisker ends (most extreme values inside the
    fences) and outlier count, as drawn by a box plot (A43).

    The quartiles, then whiskers and outliers after a join of the per-key quartile table
    back to the rows, an aggregate that combines map-side: a hot key is reduced in parallel.
    """
    base = nonnull(df, key).where(c(value).isNotNull())
    q = exact_quantiles(base, [key], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumns({"lo_fence": c("q1") - 1.5 * (c("q3") - c("q1")),
                       "hi_fence": c("q3") + 1.5 * (c("q3") - c("q1"))})
    x = c(value)
    inside = (x >= c("lo_fence")) & (x <= c("hi_fence"))
    w = base.select(key, value).join(q.select(key, "lo_fence", "hi_fence"), key).groupBy(key).agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return q.join(w, key).select(
        key, "n", rnd("q1").alias("q1"), rnd("median").alias("median"), rnd("q3").alias("q3"),
        rnd("whisker_low").alias("whisker_low"), rnd("whisker_high").alias("whisker_high"), "outliers")
