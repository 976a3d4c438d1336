"""Streaming jobs registered as queries (ST1-ST4); each returns its sink table."""

from __future__ import annotations

from larder.plans.oracle_views import osql
from larder.plans.registry import ORACLE, query
from larder.streaming import streams as ST
from larder.streaming import watermarked as W


@query("st1_sensor_hourly_stream", osql("fx_sensors", """
, g AS (SELECT date_trunc('hour', timestamp) AS window_start, date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS window_end,
               metric_name, round(avg(metric_value), 6) AS mean_value, count(metric_value) AS readings
        FROM fx_sensors WHERE timestamp IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM g WHERE window_end <= (SELECT max(timestamp) FROM fx_sensors) - INTERVAL 1 HOUR"""))
def st1_sensor_hourly_stream(spark, sf_dir):
    """Windows that end at least an hour before the newest event."""
    from pyspark.sql import functions as F
    return ST.sensor_hourly_stream(spark, sf_dir).withColumn("mean_value", F.round("mean_value", 6))


@query("st2_delay_rolling_stream", osql("fx_dispatch", """
, d AS (SELECT route_id, timestamp, (epoch_us(actual_arrival) - epoch_us(expected_arrival)) / 60000000.0 AS delay
        FROM fx_dispatch WHERE timestamp IS NOT NULL AND route_id IS NOT NULL),
w AS (SELECT route_id, delay, date_trunc('day', timestamp) - INTERVAL 1 DAY * k AS window_start
      FROM d, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k) days)
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, route_id, round(avg(delay), 6) AS mean_delay, count(delay) AS trips
FROM w GROUP BY window_start, route_id
HAVING window_start + INTERVAL 7 DAY <= (SELECT max(timestamp) FROM d) - INTERVAL 1 DAY"""))
def st2_delay_rolling_stream(spark, sf_dir):
    from pyspark.sql import functions as F
    return ST.delay_rolling_stream(spark, sf_dir).withColumn("mean_delay", F.round("mean_delay", 6))


@query("st1_sensor_hourly_watermark", ORACLE["st1_sensor_hourly_stream"])
def st1_sensor_hourly_watermark(spark, sf_dir):
    """The same windows from the state store, each appended once the watermark has passed it."""
    from pyspark.sql import functions as F
    return W.sensor_hourly.run(spark, sf_dir).select("window_start", "window_end", "metric_name", F.round("mean", 6).alias("mean_value"), F.col("n").alias("readings"))


@query("st2_delay_rolling_watermark", ORACLE["st2_delay_rolling_stream"])
def st2_delay_rolling_watermark(spark, sf_dir):
    from pyspark.sql import functions as F
    return W.delay_rolling.run(spark, sf_dir).select("window_start", "window_end", "route_id", F.round("mean", 6).alias("mean_delay"), F.col("n").alias("trips"))


@query("st3_zscore_alert_stream", osql("fx_dispatch", """
, d AS (SELECT *, (epoch_us(actual_arrival) - epoch_us(expected_arrival)) / 60000000.0 AS delay FROM fx_dispatch),
s AS (SELECT route_id, avg(delay) AS m, stddev_samp(delay) AS sd FROM d WHERE route_id IS NOT NULL GROUP BY route_id)
SELECT dispatch_id, d.route_id, timestamp, delay, round((delay - m) / nullif(sd, 0), 6) AS zscore
FROM d JOIN s ON d.route_id = s.route_id WHERE abs((delay - m) / nullif(sd, 0)) > 3"""))
def st3_zscore_alert_stream(spark, sf_dir):
    from pyspark.sql import functions as F
    df = ST.zscore_alert_stream(spark, sf_dir)
    return df.withColumn("zscore", F.round("zscore", 6))


@query("st4_ledger_alert_stream", osql("fx_inventory", """
SELECT record_id, timestamp, sku, movement_type, balance_after, balance_after < 0 AS negative_balance,
       balance_after IS DISTINCT FROM (balance_before + qty_in - qty_out) AS mismatch
FROM fx_inventory
WHERE balance_after < 0 OR balance_after IS DISTINCT FROM (balance_before + qty_in - qty_out)"""))
def st4_ledger_alert_stream(spark, sf_dir):
    return ST.ledger_alert_stream(spark, sf_dir)
