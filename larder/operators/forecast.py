"""Demand forecast per series by least squares.

A series has one row a day. Its normal equations, the sums of products of its features and
target, are one block of fixed size for each series and time segment; the blocks of all
segments before an origin add up to the equations of that origin, so one pass over
the daily rows serves every origin, and no series is ever gathered. Each (series, origin) is
one small row that a task solves; the errors of the segment behind the origin are an
aggregate again, beside those of the seasonal-naive forecast (the value a week ago).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col

FLAT = 1e-9  # equations whose determinant is at most this share of the features' variances have no solution


def daily_series(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """key, date, value for every day from the first to the last of all rows; days without rows count 0."""
    rows = rows.where(c(key).isNotNull() & c(date).isNotNull()).groupBy(key, date).agg(F.sum(value).cast("double").alias(value))
    span = rows.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))  # one row
    days = rows.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(rows, [key, date], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def lag_features(daily: DataFrame, key: str, date: str, value: str, lags: tuple[int, ...] = (1, 7)) -> DataFrame:
    """The lags and a weekend flag; days whose lags reach before the first day are left out. A window
    holds the days of one series."""
    order = Window.partitionBy(key).orderBy(date)
    out = daily.withColumns({f"lag{n}": F.lag(value, n).over(order) for n in lags})
    return out.withColumn("weekend", (F.weekday(date) >= 5).cast("double")).where(c(f"lag{max(lags)}").isNotNull())


def with_fold(rows: DataFrame, date: str, folds: int, horizon: int) -> DataFrame:
    """``part``: 0 up to the first origin, k in the ``horizon`` days behind origin k."""
    last = rows.agg(F.max(date).alias("_last"))
    behind = F.floor(F.datediff(c("_last"), c(date)) / horizon)
    return rows.crossJoin(F.broadcast(last)).withColumn("part", F.greatest(F.lit(0), F.lit(folds) - behind).cast("int")).drop("_last")


def equation_blocks(rows: DataFrame, key: str, value: str, features: list[str], by: str = "part") -> DataFrame:
    """One row a (key, part): n and the sums ``s_<a>`` and ``s_<a>_<b>`` of features and target."""
    names = [*features, value]
    sums = [F.sum(a).alias(f"s_{a}") for a in names]
    sums += [F.sum(c(a) * c(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(key, by).agg(F.count(F.lit(1)).alias("n"), *sums)


def equations_by_fold(blocks: DataFrame, key: str, folds: int, by: str = "part") -> DataFrame:
    """The blocks of all parts before each origin 1..folds, added up."""
    ahead = blocks.where(c(by) < folds).withColumn("fold", F.explode(F.sequence(c(by) + 1, F.lit(folds))))
    return ahead.groupBy(key, "fold").agg(*[F.sum(x).alias(x) for x in blocks.columns if x not in (key, by)])


def solve(equations: DataFrame, keys: list[str], value: str, features: list[str]) -> DataFrame:
    """keys, n, ``intercept`` and ``b_<feature>``; null where the features tell nothing apart."""
    names = [*features, value]
    k = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy(float)
            mean = np.stack([pdf[f"s_{a}"].to_numpy(float) for a in names], 1) / n[:, None]
            cov = np.empty((len(pdf), k + 1, k + 1))
            for i, a in enumerate(names):
                for j, b in enumerate(names[i:], i):
                    cov[:, i, j] = cov[:, j, i] = pdf[f"s_{a}_{b}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            a, y = cov[:, :k, :k], cov[:, :k, k]
            scale = np.prod(np.diagonal(a, axis1=1, axis2=2), axis=1)
            good = np.linalg.det(a) > FLAT * scale if len(pdf) else np.zeros(0, bool)
            beta = np.full((len(pdf), k), np.nan)
            if good.any():
                beta[good] = np.linalg.solve(a[good], y[good][:, :, None])[:, :, 0]
            out = pdf[[*keys, "n"]].copy()
            out["intercept"] = mean[:, k] - (beta * mean[:, :k]).sum(1)
            for i, f in enumerate(features):
                out[f"b_{f}"] = beta[:, i]
            yield out

    schema = ", ".join(f"{x} {equations.schema[x].dataType.simpleString()}" for x in [*keys, "n"])
    coefficients = ["intercept", *[f"b_{f}" for f in features]]
    out = equations.mapInPandas(run, schema + "".join(f", {x} double" for x in coefficients))
    return out.select(*keys, "n", *[F.when(~F.isnan(x), c(x)).alias(x) for x in coefficients])


def rolling_origin_errors(rows: DataFrame, coefficients: DataFrame, key: str, value: str, features: list[str], naive: str = "lag7") -> DataFrame:
    """Per key and fold: days of the segment behind the origin, mean absolute error of model and naive forecast."""
    test = rows.where(c("part") > 0).withColumn("fold", c("part")).join(coefficients.drop("n"), [key, "fold"])
    guess = c("intercept")
    for f in features:
        guess = guess + c(f"b_{f}") * c(f)
    return test.groupBy(key, "fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(c(value) - guess)).alias("mae_model"), F.avg(F.abs(c(value) - c(naive))).alias("mae_naive"))
