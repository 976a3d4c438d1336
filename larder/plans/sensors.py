"""Equipment sensor reports: R87-R90, A10, A12, A40, A42, A43, F15."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.quantiles import add_quantiles
from larder.operators.report import report, unpivot_metrics
from larder.operators.stats import box_stats, histogram
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_sensors

c = F.col
V = "metric_value"


def _ssql(body):
    return osql("fx_sensors", body)


def _stats5():
    return [F.count(V).alias("count"), S.rnd(F.avg(V)).alias("mean"), S.rnd(F.stddev_samp(V)).alias("std"),
            F.min(V).alias("min"), F.max(V).alias("max")]


_STATS5_SQL = """count(metric_value) AS count, round(avg(metric_value), 6) AS mean,
       round(stddev_samp(metric_value), 6) AS std, min(metric_value) AS min, max(metric_value) AS max"""


@query("r87_sensors_by_plant", _ssql(f"""
SELECT plant_id, {_STATS5_SQL} FROM fx_sensors WHERE plant_id IS NOT NULL GROUP BY plant_id"""))
def r87_sensors_by_plant(spark, sf_dir):
    return report(fx_sensors(spark, sf_dir), "plant_id", _stats5())


@query("r88_sensors_by_metric", _ssql(f"""
SELECT metric_name, {_STATS5_SQL} FROM fx_sensors WHERE metric_name IS NOT NULL GROUP BY metric_name"""))
def r88_sensors_by_metric(spark, sf_dir):
    return report(fx_sensors(spark, sf_dir), "metric_name", _stats5(), order=[c("count").desc()])


@query("r89_sensors_by_equipment_top50", _ssql("""
SELECT equipment_id, count(metric_value) AS count, round(avg(metric_value), 6) AS mean
FROM fx_sensors WHERE equipment_id IS NOT NULL GROUP BY equipment_id ORDER BY count DESC, equipment_id LIMIT 50"""))
def r89_sensors_by_equipment_top50(spark, sf_dir):
    return report(fx_sensors(spark, sf_dir), "equipment_id",
                  [F.count(V).alias("count"), S.rnd(F.avg(V)).alias("mean")], order=[c("count").desc()], limit=50)


@query("r90_sensors_overview", _ssql("""
SELECT count(*) AS rows, round(avg(metric_value), 6) AS mean, round(median(metric_value), 6) AS median,
       round(stddev_samp(metric_value), 6) AS std, min(metric_value) AS min, max(metric_value) AS max,
       count(DISTINCT equipment_id) AS equipment, count(DISTINCT metric_name) AS metrics FROM fx_sensors"""))
def r90_sensors_overview(spark, sf_dir):
    df = fx_sensors(spark, sf_dir)
    g = df.agg(
        F.count(F.lit(1)).alias("rows"), S.rnd(F.avg(V)).alias("mean"),
        S.rnd(F.stddev_samp(V)).alias("std"), F.min(V).alias("min"), F.max(V).alias("max"),
        S.nunique("equipment_id").alias("equipment"), S.nunique("metric_name").alias("metrics"))
    return add_quantiles(g, df, [], V, {"median": 0.5})


@query("r90_sensors_top_metrics", _ssql("""
SELECT metric_name, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM fx_sensors), 6) AS share_pct
FROM fx_sensors WHERE metric_name IS NOT NULL GROUP BY metric_name ORDER BY count DESC, metric_name LIMIT 10"""))
def r90_sensors_top_metrics(spark, sf_dir):
    """A12 value_counts: frequency, share of all rows, top 10."""
    df = fx_sensors(spark, sf_dir)
    g = report(df, "metric_name", [F.count(F.lit(1)).alias("count")], order=[c("count").desc()], limit=10)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return g.crossJoin(F.broadcast(total)).select("metric_name", "count",
                                                  S.rnd(S.pct("count", "_n")).alias("share_pct"))


@query("a10_sensor_missing_counts", _ssql("""
SELECT * FROM (
  SELECT 'plant_id' AS "column", count(*) FILTER (WHERE plant_id IS NULL) AS missing FROM fx_sensors
  UNION ALL SELECT 'metric_value', count(*) FILTER (WHERE metric_value IS NULL) FROM fx_sensors
  UNION ALL SELECT 'sensor_id', count(*) FILTER (WHERE sensor_id IS NULL) FROM fx_sensors
  UNION ALL SELECT 'timestamp', count(*) FILTER (WHERE timestamp IS NULL) FROM fx_sensors
  UNION ALL SELECT 'equipment_id', count(*) FILTER (WHERE equipment_id IS NULL) FROM fx_sensors
  UNION ALL SELECT 'metric_name', count(*) FILTER (WHERE metric_name IS NULL) FROM fx_sensors)
WHERE missing > 0"""))
def a10_sensor_missing_counts(spark, sf_dir):
    from larder.operators.profile import missing_counts
    return missing_counts(fx_sensors(spark, sf_dir))


@query("a40_sensor_hourly_mean", _ssql("""
SELECT date_trunc('hour', timestamp) AS hour, round(avg(metric_value), 6) AS mean_value, count(metric_value) AS readings
FROM fx_sensors WHERE timestamp IS NOT NULL GROUP BY 1"""))
def a40_sensor_hourly_mean(spark, sf_dir):
    df = fx_sensors(spark, sf_dir).withColumn("hour", F.date_trunc("hour", c("timestamp")))
    return report(df, "hour", [S.rnd(F.avg(V)).alias("mean_value"), F.count(V).alias("readings")])


@query("a42_sensor_value_histogram", _ssql("""
, b AS (SELECT min(metric_value) AS lo, max(metric_value) AS hi, (max(metric_value) - min(metric_value)) / 50.0 AS w
        FROM fx_sensors WHERE metric_value IS NOT NULL),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((metric_value - lo) / w), 49) END AS INT) AS bin, count(*) AS n
      FROM fx_sensors, b WHERE metric_value IS NOT NULL GROUP BY 1)
SELECT CAST(r.range AS INT) AS bin, round(lo + r.range * w, 6) AS bin_start, round(lo + (r.range + 1) * w, 6) AS bin_end,
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM range(50) r CROSS JOIN b LEFT JOIN h ON h.bin = r.range"""))
def a42_sensor_value_histogram(spark, sf_dir):
    return histogram(fx_sensors(spark, sf_dir), V, 50)


@query("a43_sensor_box_top10_metrics", _ssql("""
, top AS (SELECT metric_name FROM fx_sensors WHERE metric_name IS NOT NULL GROUP BY metric_name
          ORDER BY count(*) DESC, metric_name LIMIT 10),
s AS (SELECT * FROM fx_sensors WHERE metric_name IN (SELECT metric_name FROM top) AND metric_value IS NOT NULL),
q AS (SELECT metric_name, count(*) AS n, quantile_cont(metric_value, 0.25) AS q1, quantile_cont(metric_value, 0.5) AS med,
             quantile_cont(metric_value, 0.75) AS q3 FROM s GROUP BY metric_name),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.metric_name, n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(metric_value) FILTER (WHERE metric_value BETWEEN lo AND hi), 6) AS whisker_low,
       round(max(metric_value) FILTER (WHERE metric_value BETWEEN lo AND hi), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (metric_value BETWEEN lo AND hi)) AS outliers
FROM f JOIN s ON s.metric_name = f.metric_name GROUP BY f.metric_name, n, q1, med, q3"""))
def a43_sensor_box_top10_metrics(spark, sf_dir):
    df = fx_sensors(spark, sf_dir)
    # rows of the 10 most frequent metrics via a left-semi join on a 10-row table.
    top = report(df, "metric_name", [F.count(F.lit(1)).alias("n")], order=[c("n").desc()], limit=10)
    rows = df.join(F.broadcast(top.select("metric_name")), "metric_name", "left_semi")
    return box_stats(rows, "metric_name", V)
