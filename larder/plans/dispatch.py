"""Dispatch reports and features: C23, C24, R01-R11, W01, W02, W05, W07, M12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.quantiles import add_quantiles
from larder.operators.report import report, with_share
from larder.operators.windows import group_zscore, rolling_time_stats
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_dispatch

c = F.col
DELAY = "dispatch_delay_minutes"


def dispatch_prepared(spark, sf_dir) -> DataFrame:
    """fx_dispatch + delay, calendar fields, on-time flag and delay bucket."""
    df = fx_dispatch(spark, sf_dir)
    ts = c("timestamp")
    df = df.withColumn(DELAY, D.dispatch_delay())
    return df.withColumns({
        "hour": F.hour(ts),
        "dayofweek": S.day_name(ts),
        "day_no": S.weekday0(ts),
        "is_weekend": F.coalesce(S.is_weekend(ts), F.lit(False)),
        "abs_delay": F.abs(c(DELAY)),
        "is_delayed_15": c(DELAY) > 15,
        "on_time": D.on_time(DELAY),
        "delay_category": D.delay_category(DELAY),
    })


DISPATCH_SQL = """WITH d0 AS (
  SELECT *, (epoch_us(actual_arrival) - epoch_us(expected_arrival)) / 60000000.0 AS dispatch_delay_minutes
  FROM fx_dispatch),
d AS (
  SELECT *, hour(timestamp) AS hour, dayname(timestamp) AS dayofweek, isodow(timestamp) - 1 AS day_no,
         coalesce(isodow(timestamp) >= 6, false) AS is_weekend,
         abs(dispatch_delay_minutes) AS abs_delay, dispatch_delay_minutes > 15 AS is_delayed_15,
         coalesce(CAST(dispatch_delay_minutes BETWEEN -30 AND 30 AS INT), 0) AS on_time,
         CASE WHEN dispatch_delay_minutes <= -30 THEN 'very_early' WHEN dispatch_delay_minutes <= 0 THEN 'early'
              WHEN dispatch_delay_minutes <= 30 THEN 'on_time' WHEN dispatch_delay_minutes <= 60 THEN 'late'
              WHEN dispatch_delay_minutes > 60 THEN 'very_late' END AS delay_category
  FROM d0)
"""


def _dsql(body: str) -> str:
    return osql("fx_dispatch", DISPATCH_SQL + body)


# --- R01: delay distribution by key (A04) -------------------------------------------------------
def _delay_distribution(df, key):
    g = report(df, key, [
        F.count(DELAY).alias("delay_count"),
        S.rnd(F.avg(DELAY)).alias("delay_mean"),
        S.rnd(F.stddev_samp(DELAY)).alias("delay_std"),
    ])
    return add_quantiles(g, df, [key], DELAY, {"delay_median": 0.5, "delay_p95": 0.95})


def _r01_sql(key):
    return _dsql(f"""
SELECT {key}, count(dispatch_delay_minutes) AS delay_count, round(avg(dispatch_delay_minutes), 6) AS delay_mean,
       round(median(dispatch_delay_minutes), 6) AS delay_median,
       round(stddev_samp(dispatch_delay_minutes), 6) AS delay_std,
       round(quantile_cont(dispatch_delay_minutes, 0.95), 6) AS delay_p95
FROM d WHERE {key} IS NOT NULL GROUP BY {key}""")


for _key in ("plant_id", "route_id", "vehicle_id", "sku"):
    def _mk(key):
        def fn(spark, sf_dir):
            return _delay_distribution(dispatch_prepared(spark, sf_dir), key)
        fn.__name__ = f"r01_dispatch_delay_by_{key.replace('_id', '')}"
        return fn
    _f = _mk(_key)
    query(_f.__name__, _r01_sql(_key))(_f)


# --- R02: describe of the delay (A06, exact quartiles) --------------------------------------------
@query("r02_dispatch_delay_overall", _dsql("""
SELECT count(dispatch_delay_minutes) AS count, round(avg(dispatch_delay_minutes), 6) AS mean,
       round(stddev_samp(dispatch_delay_minutes), 6) AS std, min(dispatch_delay_minutes) AS min,
       round(quantile_cont(dispatch_delay_minutes, 0.25), 6) AS p25,
       round(quantile_cont(dispatch_delay_minutes, 0.5), 6) AS p50,
       round(quantile_cont(dispatch_delay_minutes, 0.75), 6) AS p75, max(dispatch_delay_minutes) AS max
FROM d"""))
def r02_dispatch_delay_overall(spark, sf_dir):
    from larder.operators.stats import describe
    return describe(dispatch_prepared(spark, sf_dir), DELAY)


# --- R03-R08 -------------------------------------------------------------------------------------
@query("r03_dispatch_by_plant", _dsql("""
SELECT plant_id, count(dispatch_id) AS total_dispatches, CAST(sum(qty_dispatched) AS BIGINT) AS total_qty,
       round(avg(qty_dispatched), 6) AS mean_qty_per_dispatch,
       round(avg(dispatch_delay_minutes), 6) AS mean_delay_min, round(median(dispatch_delay_minutes), 6) AS median_delay_min,
       round(avg(on_time), 6) AS on_time_rate, count(DISTINCT route_id) AS unique_routes,
       count(DISTINCT vehicle_id) AS unique_vehicles, count(DISTINCT retailer_id) AS unique_retailers,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE plant_id IS NOT NULL GROUP BY plant_id"""))
def r03_dispatch_by_plant(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir)
    g = report(df, "plant_id", [
        F.count("dispatch_id").alias("total_dispatches"),
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg("qty_dispatched")).alias("mean_qty_per_dispatch"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(F.avg("on_time")).alias("on_time_rate"),
        S.nunique("route_id").alias("unique_routes"),
        S.nunique("vehicle_id").alias("unique_vehicles"),
        S.nunique("retailer_id").alias("unique_retailers"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ])
    return add_quantiles(g, df, ["plant_id"], DELAY, {"median_delay_min": 0.5})


@query("r04_dispatch_by_route", _dsql("""
SELECT route_id, count(dispatch_id) AS total_dispatches, CAST(sum(qty_dispatched) AS BIGINT) AS total_qty,
       round(avg(qty_dispatched), 6) AS mean_qty,
       round(avg(dispatch_delay_minutes), 6) AS mean_delay_min, round(median(dispatch_delay_minutes), 6) AS median_delay_min,
       round(stddev_samp(dispatch_delay_minutes), 6) AS std_delay_min,
       round(avg(on_time), 6) AS on_time_rate, count(DISTINCT retailer_id) AS unique_retailers,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE route_id IS NOT NULL GROUP BY route_id"""))
def r04_dispatch_by_route(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "route_id", [
        F.count("dispatch_id").alias("total_dispatches"),
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg("qty_dispatched")).alias("mean_qty"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(F.median(DELAY)).alias("median_delay_min"),
        S.rnd(F.stddev_samp(DELAY)).alias("std_delay_min"),
        S.rnd(F.avg("on_time")).alias("on_time_rate"),
        S.nunique("retailer_id").alias("unique_retailers"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("mean_delay_min").desc()])


@query("r05_dispatch_by_vehicle", _dsql("""
SELECT vehicle_id, count(dispatch_id) AS total_trips, CAST(sum(qty_dispatched) AS BIGINT) AS total_qty,
       round(avg(dispatch_delay_minutes), 6) AS mean_delay_min, round(median(dispatch_delay_minutes), 6) AS median_delay_min,
       round(avg(on_time), 6) AS on_time_rate, count(DISTINCT route_id) AS unique_routes,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id"""))
def r05_dispatch_by_vehicle(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "vehicle_id", [
        F.count("dispatch_id").alias("total_trips"),
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(F.median(DELAY)).alias("median_delay_min"),
        S.rnd(F.avg("on_time")).alias("on_time_rate"),
        S.nunique("route_id").alias("unique_routes"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("mean_delay_min").desc()])


@query("r06_dispatch_by_sku", _dsql("""
SELECT sku, count(dispatch_id) AS total_dispatches, CAST(sum(qty_dispatched) AS BIGINT) AS total_qty,
       round(avg(qty_dispatched), 6) AS mean_qty,
       round(avg(dispatch_delay_minutes), 6) AS mean_delay_min, round(median(dispatch_delay_minutes), 6) AS median_delay_min,
       round(avg(on_time), 6) AS on_time_rate, round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE sku IS NOT NULL GROUP BY sku"""))
def r06_dispatch_by_sku(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "sku", [
        F.count("dispatch_id").alias("total_dispatches"),
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg("qty_dispatched")).alias("mean_qty"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(F.median(DELAY)).alias("median_delay_min"),
        S.rnd(F.avg("on_time")).alias("on_time_rate"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("total_qty").desc()])


@query("r07_dispatch_by_retailer_top50", _dsql("""
SELECT retailer_id, count(dispatch_id) AS total_deliveries, CAST(sum(qty_dispatched) AS BIGINT) AS total_qty,
       round(avg(dispatch_delay_minutes), 6) AS mean_delay_min, round(avg(on_time), 6) AS on_time_rate,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE retailer_id IS NOT NULL GROUP BY retailer_id ORDER BY total_qty DESC, retailer_id LIMIT 50"""))
def r07_dispatch_by_retailer_top50(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "retailer_id", [
        F.count("dispatch_id").alias("total_deliveries"),
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(F.avg("on_time")).alias("on_time_rate"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("total_qty").desc()], limit=50)


@query("r08_dispatch_by_hour", _dsql("""
SELECT hour, count(dispatch_id) AS dispatches, round(avg(dispatch_delay_minutes), 6) AS mean_delay_min,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE hour IS NOT NULL GROUP BY hour"""))
def r08_dispatch_by_hour(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "hour", [
        F.count("dispatch_id").alias("dispatches"),
        S.rnd(F.avg(DELAY)).alias("mean_delay_min"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("hour")])


# --- R09: worst routes (top 10 by mean delay) and vehicles (top 5, >= 10 trips: F09) ----------------
@query("r09_worst_routes", _dsql("""
SELECT route_id, count(dispatch_delay_minutes) AS trips, round(avg(dispatch_delay_minutes), 6) AS mean_delay,
       round(median(dispatch_delay_minutes), 6) AS median_delay, round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE route_id IS NOT NULL GROUP BY route_id
ORDER BY avg(dispatch_delay_minutes) DESC, route_id LIMIT 10"""))
def r09_worst_routes(spark, sf_dir):
    g = report(dispatch_prepared(spark, sf_dir), "route_id", [
        F.count(DELAY).alias("trips"),
        F.avg(DELAY).alias("_mean"),
        S.rnd(F.median(DELAY)).alias("median_delay"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], order=[c("_mean").desc()], limit=10)
    return g.select("route_id", "trips", S.rnd("_mean").alias("mean_delay"), "median_delay", "on_time_pct")


@query("r09_worst_vehicles", _dsql("""
SELECT vehicle_id, count(dispatch_delay_minutes) AS trips, round(avg(dispatch_delay_minutes), 6) AS mean_delay,
       round(avg(on_time) * 100, 6) AS on_time_pct
FROM d WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id HAVING count(dispatch_delay_minutes) >= 10
ORDER BY avg(dispatch_delay_minutes) DESC, vehicle_id LIMIT 5"""))
def r09_worst_vehicles(spark, sf_dir):
    g = report(dispatch_prepared(spark, sf_dir), "vehicle_id", [
        F.count(DELAY).alias("trips"),
        F.avg(DELAY).alias("_mean"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
    ], having=c("trips") >= 10, order=[c("_mean").desc()], limit=5)
    return g.select("vehicle_id", "trips", S.rnd("_mean").alias("mean_delay"), "on_time_pct")


# --- R10: weekday delays (J06), delay categories with empty buckets (C24), hour extremes (A19) -------
@query("r10_delay_by_weekday", _dsql("""
, dim AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                                 (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(day_no, day_name)),
g AS (SELECT day_no, round(avg(dispatch_delay_minutes), 6) AS mean_delay, count(dispatch_id) AS dispatches
      FROM d WHERE day_no IS NOT NULL GROUP BY day_no)
SELECT CAST(dim.day_no AS INT) AS day_no, day_name, mean_delay, dispatches FROM dim LEFT JOIN g ON g.day_no = dim.day_no"""))
def r10_delay_by_weekday(spark, sf_dir):
    from larder.plans.pos import _weekday_dim
    g = report(dispatch_prepared(spark, sf_dir), "day_no", [
        S.rnd(F.avg(DELAY)).alias("mean_delay"),
        F.count("dispatch_id").alias("dispatches"),
    ]).withColumnRenamed("day_no", "g_day")
    return (_weekday_dim(spark).join(g, c("day_no") == c("g_day"), "left")
            .select("day_no", "day_name", "mean_delay", "dispatches"))


@query("r10_delay_categories", _dsql("""
, dim AS (SELECT * FROM (VALUES (1, 'very_early'), (2, 'early'), (3, 'on_time'), (4, 'late'), (5, 'very_late'))
          t(order_no, delay_category)),
g AS (SELECT delay_category, count(*) AS n FROM d WHERE delay_category IS NOT NULL GROUP BY delay_category),
tot AS (SELECT count(*) AS rows FROM d)
SELECT CAST(order_no AS INT) AS order_no, dim.delay_category, CAST(coalesce(n, 0) AS BIGINT) AS dispatches,
       round(coalesce(n, 0) * 100.0 / rows, 6) AS pct
FROM dim LEFT JOIN g ON g.delay_category = dim.delay_category CROSS JOIN tot"""))
def r10_delay_categories(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir)
    dim = F.broadcast(spark.createDataFrame(
        [(i + 1, lab) for i, lab in enumerate(D.DELAY_LABELS)], "order_no int, delay_category string"))
    # Bucket counts and the row total come from one aggregate (grouping sets).
    g = report(df, "delay_category", [F.count(F.lit(1)).alias("n")])
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    out = dim.join(g, "delay_category", "left").crossJoin(F.broadcast(total))
    return out.select("order_no", "delay_category",
                      F.coalesce(c("n"), F.lit(0)).cast("bigint").alias("dispatches"),
                      S.rnd(S.pct(F.coalesce(c("n"), F.lit(0)), c("rows"))).alias("pct"))


@query("r10_delay_hour_extremes", _dsql("""
, h AS (SELECT hour, avg(dispatch_delay_minutes) AS m FROM d WHERE hour IS NOT NULL GROUP BY hour)
SELECT arg_max(hour, (m, -hour)) AS peak_hour, round(max(m), 6) AS peak_delay,
       arg_min(hour, (m, hour)) AS best_hour, round(min(m), 6) AS best_delay FROM h"""))
def r10_delay_hour_extremes(spark, sf_dir):
    h = report(dispatch_prepared(spark, sf_dir), "hour", [F.avg(DELAY).alias("m")])
    return h.agg(
        F.max_by("hour", F.struct(c("m"), -c("hour"))).alias("peak_hour"),
        S.rnd(F.max("m")).alias("peak_delay"),
        F.min_by("hour", F.struct(c("m"), c("hour"))).alias("best_hour"),
        S.rnd(F.min("m")).alias("best_delay"),
    )


# --- R11: volume overview + plant shares ------------------------------------------------------------
@query("r11_dispatch_overview", _dsql("""
SELECT CAST(sum(qty_dispatched) AS BIGINT) AS total_qty, round(avg(qty_dispatched), 6) AS mean_qty,
       count(*) AS events, count(DISTINCT plant_id) AS plants,
       count(DISTINCT route_id) AS routes, round(count(*) / count(DISTINCT route_id), 6) AS dispatches_per_route,
       count(DISTINCT vehicle_id) AS vehicles, round(count(*) / count(DISTINCT vehicle_id), 6) AS dispatches_per_vehicle,
       count(DISTINCT retailer_id) AS retailers, round(count(*) / count(DISTINCT retailer_id), 6) AS deliveries_per_retailer,
       count(DISTINCT sku) AS skus, round(avg(dispatch_delay_minutes), 6) AS mean_delay,
       round(median(dispatch_delay_minutes), 6) AS median_delay,
       round(quantile_cont(dispatch_delay_minutes, 0.95), 6) AS p95_delay, round(avg(on_time) * 100, 6) AS on_time_pct,
       min(timestamp) AS first_ts, max(timestamp) AS last_ts
FROM d"""))
def r11_dispatch_overview(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir)
    n = F.count(F.lit(1))
    g = df.agg(
        F.sum("qty_dispatched").alias("total_qty"),
        S.rnd(F.avg("qty_dispatched")).alias("mean_qty"),
        n.alias("events"),
        S.nunique("plant_id").alias("plants"),
        S.nunique("route_id").alias("routes"),
        S.rnd(S.ratio(n, S.nunique("route_id"))).alias("dispatches_per_route"),
        S.nunique("vehicle_id").alias("vehicles"),
        S.rnd(S.ratio(n, S.nunique("vehicle_id"))).alias("dispatches_per_vehicle"),
        S.nunique("retailer_id").alias("retailers"),
        S.rnd(S.ratio(n, S.nunique("retailer_id"))).alias("deliveries_per_retailer"),
        S.nunique("sku").alias("skus"),
        S.rnd(F.avg(DELAY)).alias("mean_delay"),
        S.rnd(S.rate("on_time")).alias("on_time_pct"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return add_quantiles(g, df, [], DELAY, {"median_delay": 0.5, "p95_delay": 0.95})


@query("r11_dispatch_plant_share", _dsql("""
SELECT plant_id, count(*) AS dispatches, round(count(*) * 100.0 / (SELECT count(*) FROM d), 6) AS pct
FROM d WHERE plant_id IS NOT NULL GROUP BY plant_id"""))
def r11_dispatch_plant_share(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir)
    g = report(df, "plant_id", [F.count(F.lit(1)).alias("dispatches")])
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    return (g.crossJoin(F.broadcast(total))
             .select("plant_id", "dispatches", S.rnd(S.pct("dispatches", "rows")).alias("pct")))


@query("r11_dispatch_top5_skus", _dsql("""
SELECT sku, count(*) AS dispatches, round(count(*) * 100.0 / (SELECT count(*) FROM d), 6) AS pct
FROM d WHERE sku IS NOT NULL GROUP BY sku ORDER BY dispatches DESC, sku LIMIT 5"""))
def r11_dispatch_top5_skus(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir)
    g = report(df, "sku", [F.count(F.lit(1)).alias("dispatches")], order=[c("dispatches").desc()], limit=5)
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    return g.crossJoin(F.broadcast(total)).select("sku", "dispatches", S.rnd(S.pct("dispatches", "rows")).alias("pct"))


# --- W01 / W02 / M12: rolling features, route z-score, feature table ------------------------------------
_ROLL_SQL_STATS = """
  CASE WHEN {k} IS NOT NULL AND timestamp IS NOT NULL THEN round(avg(dispatch_delay_minutes) OVER w_{k}_{n}, 6) END AS {k}_mean_{n}D,
  CASE WHEN {k} IS NOT NULL AND timestamp IS NOT NULL THEN round(median(dispatch_delay_minutes) OVER w_{k}_{n}, 6) END AS {k}_median_{n}D,
  CASE WHEN {k} IS NOT NULL AND timestamp IS NOT NULL THEN round(coalesce(stddev_samp(dispatch_delay_minutes) OVER w_{k}_{n}, 0), 6) END AS {k}_std_{n}D,
  CASE WHEN {k} IS NOT NULL AND timestamp IS NOT NULL THEN count(dispatch_delay_minutes) OVER w_{k}_{n} ELSE 0 END AS {k}_count_{n}D"""
_ROLL_SQL_WINDOWS = """
  w_{k}_{n} AS (PARTITION BY {k} ORDER BY timestamp RANGE BETWEEN INTERVAL '{m} days 23:59:59.999999' PRECEDING AND CURRENT ROW)"""


def _roll_sql():
    stats, wins = [], []
    for k in ("route_id", "plant_id"):
        for n in (7, 30):
            stats.append(_ROLL_SQL_STATS.format(k=k, n=n))
            wins.append(_ROLL_SQL_WINDOWS.format(k=k, n=n, m=n - 1))
    return ",".join(stats), ",".join(wins)


ROLL_COLS = [f"{k}_{s}_{n}D" for k in ("route_id", "plant_id") for n in (7, 30)
             for s in ("mean", "median", "std", "count")]


def rolling_features(df: DataFrame, method: str = "auto") -> DataFrame:
    from larder.operators.rolling import rolling_time_stats_blocked
    from larder.session import ship_package
    ship_package(df.sparkSession)
    for key in ("route_id", "plant_id"):
        if method == "window":
            for w in ("7D", "30D"):
                df = rolling_time_stats(df, key, "timestamp", DELAY, w)
        else:
            df = rolling_time_stats_blocked(df, key, "timestamp", DELAY, ("7D", "30D"), id_col="dispatch_id")
    return df


def _round_roll(df):
    return df.withColumns({x: S.rnd(x) for x in ROLL_COLS if not x.endswith(("count_7D", "count_30D"))})


_S, _W = _roll_sql()


@query("w01_dispatch_rolling", _dsql(f"""
SELECT dispatch_id, {_S}
FROM d WINDOW {_W}"""))
def w01_dispatch_rolling(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir).select("dispatch_id", "route_id", "plant_id", "timestamp", DELAY)
    out = _round_roll(rolling_features(df))
    return out.select("dispatch_id", *ROLL_COLS)


@query("w02_route_zscore", _dsql("""
, s AS (SELECT route_id, avg(dispatch_delay_minutes) AS m, stddev_samp(dispatch_delay_minutes) AS sd
        FROM d WHERE route_id IS NOT NULL GROUP BY route_id)
SELECT dispatch_id, d.route_id, round(m, 6) AS route_id_mean, round(sd, 6) AS route_id_std,
       round((dispatch_delay_minutes - m) / nullif(sd, 0), 6) AS route_id_zscore
FROM d LEFT JOIN s ON d.route_id = s.route_id"""))
def w02_route_zscore(spark, sf_dir):
    df = dispatch_prepared(spark, sf_dir).select("dispatch_id", "route_id", DELAY)
    z = group_zscore(df, "route_id", DELAY)
    return z.select("dispatch_id", "route_id", S.rnd("route_id_mean").alias("route_id_mean"),
                    S.rnd("route_id_std").alias("route_id_std"), S.rnd("route_id_zscore").alias("route_id_zscore"))


FEATURE_BASE = ["dispatch_id", "timestamp", "plant_id", "route_id", "vehicle_id", "retailer_id", "sku",
                "qty_dispatched", DELAY, "hour", "dayofweek", "is_weekend", "abs_delay", "is_delayed_15"]


def dispatch_features(spark, sf_dir, method: str = "auto") -> DataFrame:
    """One lazy plan -> the 33-column feature table (arrival columns dropped)."""
    df = dispatch_prepared(spark, sf_dir).select(*FEATURE_BASE)
    # z-score first: its per-route aggregate then reads the scan, not the
    # rolling stages, so those are computed once.
    df = group_zscore(df, "route_id", DELAY)
    return rolling_features(df, method)


@query("m12_dispatch_features", _dsql(f"""
, s AS (SELECT route_id AS s_route, avg(dispatch_delay_minutes) AS m, stddev_samp(dispatch_delay_minutes) AS sd
        FROM d WHERE route_id IS NOT NULL GROUP BY route_id),
r AS (SELECT *, {_S} FROM d WINDOW {_W})
SELECT {", ".join(FEATURE_BASE)}, {", ".join(ROLL_COLS)},
       round(m, 6) AS route_id_mean, round(sd, 6) AS route_id_std,
       round((dispatch_delay_minutes - m) / nullif(sd, 0), 6) AS route_id_zscore
FROM r LEFT JOIN s ON r.route_id = s.s_route"""))
def m12_dispatch_features(spark, sf_dir):
    df = _round_roll(dispatch_features(spark, sf_dir))
    return df.select(*FEATURE_BASE, *ROLL_COLS,
                     S.rnd("route_id_mean").alias("route_id_mean"), S.rnd("route_id_std").alias("route_id_std"),
                     S.rnd("route_id_zscore").alias("route_id_zscore"))


# --- W05: global z-score of the delay, |z| > 3 flag -------------------------------------------------
@query("w05_delay_global_zscore", _dsql("""
, s AS (SELECT avg(dispatch_delay_minutes) AS m,
               CASE WHEN stddev_samp(dispatch_delay_minutes) > 0 THEN stddev_samp(dispatch_delay_minutes) ELSE 1.0 END AS sd
        FROM d)
SELECT dispatch_id, round((dispatch_delay_minutes - m) / sd, 6) AS delay_zscore,
       abs((dispatch_delay_minutes - m) / sd) > 3 AS z_anomaly
FROM d CROSS JOIN s"""))
def w05_delay_global_zscore(spark, sf_dir):
    from larder.operators.anomaly import global_zscore
    df = dispatch_prepared(spark, sf_dir).select("dispatch_id", DELAY)
    z = global_zscore(df, DELAY, "delay_zscore", threshold=3.0, flag="z_anomaly")
    return z.select("dispatch_id", S.rnd("delay_zscore").alias("delay_zscore"), "z_anomaly")


# --- W07: date segments for time-ordered folds --------------------------------------------------------
@query("w07_date_segments", _dsql("""
, dates AS (SELECT DISTINCT CAST(timestamp AS DATE) AS date FROM d WHERE timestamp IS NOT NULL)
SELECT date, CAST(ntile(5) OVER (ORDER BY date) AS INT) AS segment FROM dates"""))
def w07_date_segments(spark, sf_dir):
    from larder.operators.anomaly import fold_segments
    df = dispatch_prepared(spark, sf_dir)
    return fold_segments(df, "timestamp", 5)


__all__ = ["dispatch_prepared", "dispatch_features", "with_share"]
