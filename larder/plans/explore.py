"""Exploration and evaluation queries: F05-F07, F13, F14, A07, A26, A37, A38, T06, T07, R37, M07, M08, and finished report parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators import evaluate as E
from larder.operators import explore as X
from larder.operators.quantiles import add_quantiles
from larder.operators.report import report
from larder.operators.stages import written
from larder.operators.windows import group_zscore
from larder.plans.b2b import _bsql, b2b_rows, b2b_units, priced
from larder.plans.dispatch import DELAY, _dsql, dispatch_prepared
from larder.plans.registry import query

c = F.col

# What a user picks in the filters of these queries.
ROUTES, PLANTS = ["RT_1", "RT_2", "RT_3", "RT_5", "RT_8"], ["PLANT_A", "PLANT_B"]
FIRST, LAST = date(2024, 1, 5), date(2024, 1, 20)
_IN = "route_id IN ('RT_1', 'RT_2', 'RT_3', 'RT_5', 'RT_8')"
_RANGE = "timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-21 00:00:00'"
_COUNTS = "SELECT route_id, count(*) AS dispatches, round(avg(dispatch_delay_minutes), 6) AS mean_delay FROM d WHERE {} AND route_id IS NOT NULL GROUP BY route_id"


def _by_route(df):
    return report(df, "route_id", [F.count(F.lit(1)).alias("dispatches"), S.rnd(F.avg(DELAY)).alias("mean_delay")])


@query("f05_dispatch_of_routes", _dsql(_COUNTS.format(_IN)))
def f05_dispatch_of_routes(spark, sf_dir):
    return _by_route(X.in_list(dispatch_prepared(spark, sf_dir), "route_id", ROUTES))


@query("f06_dispatch_of_days", _dsql(_COUNTS.format(_RANGE)))
def f06_dispatch_of_days(spark, sf_dir):
    return _by_route(X.date_range(dispatch_prepared(spark, sf_dir), "timestamp", FIRST, LAST))


@query("f07_dispatch_selection", _dsql(f"SELECT dispatch_id, timestamp, plant_id, route_id, sku, dispatch_delay_minutes FROM d WHERE {_IN} AND {_RANGE}"))
def f07_dispatch_selection(spark, sf_dir):
    d = X.select_rows(dispatch_prepared(spark, sf_dir), {"route_id": ROUTES}, "timestamp", FIRST, LAST)
    return d.select("dispatch_id", "timestamp", "plant_id", "route_id", "sku", DELAY)


NUMBERS, TEXTS = ["qty_dispatched", DELAY, "abs_delay"], ["plant_id", "route_id", "sku", "dayofweek"]


@query("a07_dispatch_describe", _dsql(" UNION ALL ".join(
    [f"""SELECT '{n}' AS column_name, count({n}) AS n, round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS std, CAST(min({n}) AS DOUBLE) AS min,
     CAST(max({n}) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS distinct_values, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM d""" for n in NUMBERS]
    + [f"""SELECT '{t}' AS column_name, CAST(sum(k) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
     CAST(NULL AS DOUBLE) AS max, count(*) AS distinct_values, arg_min(v, r) AS top, max(k) AS freq
     FROM (SELECT v, k, row_number() OVER (ORDER BY k DESC, v) AS r FROM (SELECT {t} AS v, count(*) AS k FROM d WHERE {t} IS NOT NULL GROUP BY {t}) q) z""" for t in TEXTS])))
def a07_dispatch_describe(spark, sf_dir):
    return X.describe_all(dispatch_prepared(spark, sf_dir), NUMBERS, TEXTS)


@query("a37_dispatch_describe_by_plant", _dsql("SELECT plant_id, " + ", ".join(
    f"round(avg({n}), 6) AS {n}_mean, round(median({n}), 6) AS {n}_median, round(stddev_samp({n}), 6) AS {n}_std, count({n}) AS {n}_count" for n in NUMBERS)
    + " FROM d WHERE plant_id IS NOT NULL GROUP BY plant_id"))
def a37_dispatch_describe_by_plant(spark, sf_dir):
    return X.describe_by(dispatch_prepared(spark, sf_dir), "plant_id", NUMBERS)


PAIRED = ["qty_dispatched", DELAY, "abs_delay", "hour", "day_no"]
_PAIRS = [(x, y) for i, x in enumerate(PAIRED) for y in PAIRED[i + 1:]]


@query("a26_dispatch_correlation", _dsql(" UNION ALL ".join(f"SELECT '{x}' AS column_x, '{y}' AS column_y, round(corr({x}, {y}), 6) AS corr FROM d" for x, y in _PAIRS)))
def a26_dispatch_correlation(spark, sf_dir):
    return X.correlation_matrix(dispatch_prepared(spark, sf_dir), PAIRED)


@query("a38_dispatch_kpis", _dsql("""
SELECT count(*) AS dispatches, round(avg(dispatch_delay_minutes), 6) AS mean_delay,
       round(100.0 * count(*) FILTER (WHERE dispatch_delay_minutes > 15) / count(*), 6) AS pct_over_15, count(DISTINCT route_id) AS routes FROM d"""))
def a38_dispatch_kpis(spark, sf_dir):
    d = dispatch_prepared(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("dispatches"), S.rnd(F.avg(DELAY)).alias("mean_delay"),
                 S.rnd(S.pct(F.count_if(c(DELAY) > 15), F.count(F.lit(1)))).alias("pct_over_15"), S.nunique("route_id").alias("routes"))


@query("t07_top_sku_per_depot", _bsql("""
SELECT depot_id, arg_min(sku, r) AS top_sku, max(u) AS units FROM (
  SELECT depot_id, sku, u, row_number() OVER (PARTITION BY depot_id ORDER BY u DESC, sku) AS r
  FROM (SELECT depot_id, sku, sum(quantity_sold) AS u FROM b GROUP BY depot_id, sku) q) z GROUP BY depot_id"""))
def t07_top_sku_per_depot(spark, sf_dir):
    g = b2b_units(spark, sf_dir).groupBy("depot_id", "sku").agg(F.sum("quantity_sold").alias("u"))
    best = g.groupBy("depot_id").agg(F.min(F.struct((-c("u")).alias("u"), "sku")).alias("b"))
    return best.select("depot_id", c("b.sku").alias("top_sku"), (-c("b.u")).alias("units"))


_PRICE = """count(price_per_unit) AS prices, round(avg(price_per_unit), 6) AS price_mean, round(median(price_per_unit), 6) AS price_median,
       round(stddev_samp(price_per_unit), 6) AS price_std, round(min(price_per_unit), 6) AS price_min, round(max(price_per_unit), 6) AS price_max"""


@query("r37_b2b_price_stats", _bsql(f"SELECT sku, {_PRICE} FROM b GROUP BY sku UNION ALL SELECT 'ALL' AS sku, {_PRICE} FROM b"))
def r37_b2b_price_stats(spark, sf_dir):
    p = "price_per_unit"
    stats = [F.count(p).alias("prices"), S.rnd(F.avg(p)).alias("price_mean"), S.rnd(F.stddev_samp(p)).alias("price_std"),
             S.rnd(F.min(p)).alias("price_min"), S.rnd(F.max(p)).alias("price_max")]
    # Prices alone are written, unfilled and filled: every pass reads those.
    b = written(priced(written(b2b_rows(spark, sf_dir).select("sku", p), "prices")), "filled-prices")
    by_sku = add_quantiles(b.groupBy("sku").agg(*stats), b, ["sku"], p, {"price_median": 0.5}, stored=True)
    overall = add_quantiles(b.agg(*stats), b, [], p, {"price_median": 0.5}, stored=True).withColumn("sku", F.lit("ALL"))
    return by_sku.unionByName(overall).select("sku", "prices", "price_mean", "price_median", "price_std", "price_min", "price_max")


# A dispatch is labelled an anomaly if it comes over an hour late; the detectors see the route's own spread.
_Z = """
, s AS (SELECT route_id, avg(dispatch_delay_minutes) AS m, stddev_samp(dispatch_delay_minutes) AS sd FROM d WHERE route_id IS NOT NULL GROUP BY route_id),
z AS (SELECT d.dispatch_delay_minutes > 60 AS anomaly, abs((dispatch_delay_minutes - m) / nullif(sd, 0)) AS score, qty_dispatched
      FROM d JOIN s ON d.route_id = s.route_id WHERE dispatch_delay_minutes IS NOT NULL)"""


def _labelled(spark, sf_dir):
    d = dispatch_prepared(spark, sf_dir).select("dispatch_id", "route_id", "qty_dispatched", DELAY).where(c("route_id").isNotNull() & c(DELAY).isNotNull())
    z = group_zscore(d, "route_id", DELAY)
    return z.select((c(DELAY) > 60).alias("anomaly"), F.abs("route_id_zscore").alias("score"), "qty_dispatched")


@query("m07_precision_recall", _dsql(_Z + " UNION ALL ".join("""
SELECT detector, tp, fp, fn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
       round(coalesce(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT 'zscore_{t}' AS detector, count(*) FILTER (WHERE score > {t} AND anomaly) AS tp, count(*) FILTER (WHERE score > {t} AND NOT anomaly) AS fp,
             count(*) FILTER (WHERE NOT coalesce(score > {t}, false) AND anomaly) AS fn FROM z) q""".format(t=t) for t in (1, 2, 3))))
def m07_precision_recall(spark, sf_dir):
    z = _labelled(spark, sf_dir)
    return E.precision_recall(z, c(E.label_column(z)), {f"zscore_{t}": c("score") > t for t in (1, 2, 3)})


@query("m08_roc_auc", _dsql(_Z + """
, g AS (SELECT round(score, 9) AS s, count(*) FILTER (WHERE anomaly) AS p, count(*) FILTER (WHERE NOT anomaly) AS n FROM z WHERE score IS NOT NULL GROUP BY 1),
w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(p * (below + n / 2.0)) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0), 6) AS auc FROM w"""))
def m08_roc_auc(spark, sf_dir):
    z = _labelled(spark, sf_dir)
    return E.roc_auc(z, c(E.label_column(z)), F.round("score", 9))
