"""Cross-dataset jobs described by the reference's documents.

Every join here joins *aggregates*: each side is reduced to one row per key
first (partial + final aggregation), so the shuffle carries keys, not fact
rows, and a hot key is pre-aggregated before it is shuffled. Only the retailer
master (a fixed-size dimension) is broadcast explicitly; other strategies are
left to AQE, which measures the aggregated sides at runtime.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.report import report
from larder.plans.b2b import b2b_prepared
from larder.plans.dispatch import DELAY, dispatch_prepared
from larder.plans.inventory import inventory_prepared
from larder.plans.oracle_views import osql
from larder.plans.pos import pos_prepared
from larder.plans.qc import qc_prepared
from larder.plans.registry import query
from larder.plans.routes import routes_prepared
from larder.sources.fixtures import fx_production, fx_retailer_master, fx_returns, fx_waste

c = F.col


@query("p01_qc_to_waste", osql(["fx_qc", "fx_waste"], """
, f AS (SELECT batch_id, count(*) AS failed_checks FROM fx_qc
        WHERE lower(trim(pass_fail)) = 'fail' AND batch_id IS NOT NULL GROUP BY batch_id),
w AS (SELECT batch_id, CAST(sum(qty_waste) AS BIGINT) AS wasted_units, count(*) AS waste_incidents
      FROM fx_waste WHERE batch_id IS NOT NULL GROUP BY batch_id)
SELECT f.batch_id, failed_checks, wasted_units, waste_incidents FROM f JOIN w ON f.batch_id = w.batch_id"""))
def p01_qc_to_waste(spark, sf_dir):
    failed = report(qc_prepared(spark, sf_dir).where(c("is_fail") == 1), "batch_id",
                    [F.count(F.lit(1)).alias("failed_checks")])
    waste = report(fx_waste(spark, sf_dir), "batch_id",
                   [S.sum0("qty_waste").alias("wasted_units"), F.count(F.lit(1)).alias("waste_incidents")])
    return failed.join(waste, "batch_id")


@query("p02_qc_by_line", osql(["fx_qc", "fx_production"], """
, q AS (SELECT batch_id, max(CAST(lower(trim(pass_fail)) = 'fail' AS INT)) AS any_fail, count(*) AS checks
        FROM fx_qc WHERE batch_id IS NOT NULL GROUP BY batch_id),
p AS (SELECT DISTINCT batch_id, line_id FROM fx_production WHERE line_id IS NOT NULL)
SELECT line_id, count(DISTINCT p.batch_id) AS batches, count(DISTINCT p.batch_id) FILTER (WHERE any_fail = 1) AS failed_batches,
       round(count(DISTINCT p.batch_id) FILTER (WHERE any_fail = 1) * 100.0 / count(DISTINCT p.batch_id), 6) AS failed_batch_pct
FROM p JOIN q ON p.batch_id = q.batch_id GROUP BY line_id"""))
def p02_qc_by_line(spark, sf_dir):
    q = report(qc_prepared(spark, sf_dir), "batch_id",
               [F.max("is_fail").alias("any_fail"), F.count(F.lit(1)).alias("checks")])
    p = fx_production(spark, sf_dir).where(c("line_id").isNotNull()).select("batch_id", "line_id").distinct()
    j = p.join(q, "batch_id")
    failed = F.countDistinct(F.when(c("any_fail") == 1, c("batch_id")))
    return j.groupBy("line_id").agg(S.nunique("batch_id").alias("batches"), failed.alias("failed_batches"),
                                    S.rnd(S.pct(failed, S.nunique("batch_id"))).alias("failed_batch_pct"))


@query("p04_ledger_reconcile", osql(["fx_production", "fx_inventory"], """
, src AS (SELECT CAST(timestamp AS DATE) AS date, sku, CAST(sum(quantity_produced) AS BIGINT) AS source_units
          FROM fx_production WHERE timestamp IS NOT NULL GROUP BY 1, 2),
led AS (SELECT CAST(timestamp AS DATE) AS date, sku, CAST(sum(qty_in) AS BIGINT) AS ledger_units
        FROM fx_inventory WHERE movement_type = 'production' AND timestamp IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(src.date, led.date) AS date, coalesce(src.sku, led.sku) AS sku,
       CAST(coalesce(source_units, 0) AS BIGINT) AS source_units, CAST(coalesce(ledger_units, 0) AS BIGINT) AS ledger_units,
       CAST(coalesce(ledger_units, 0) - coalesce(source_units, 0) AS BIGINT) AS diff,
       CASE WHEN src.sku IS NULL THEN 'missing_in_source' WHEN led.sku IS NULL THEN 'missing_in_ledger'
            WHEN ledger_units = source_units THEN 'match' ELSE 'mismatch' END AS status
FROM src FULL OUTER JOIN led ON src.date = led.date AND src.sku = led.sku"""))
def p04_ledger_reconcile(spark, sf_dir):
    """Production source vs ledger production movements by day and SKU (full outer join)."""
    src = report(fx_production(spark, sf_dir).withColumn("date", F.to_date("timestamp")), ["date", "sku"],
                 [S.sum0("quantity_produced").alias("source_units")])
    led = report(inventory_prepared(spark, sf_dir).where(c("movement_type") == "production"), ["date", "sku"],
                 [S.sum0("qty_in").alias("ledger_units")])
    j = src.withColumn("_s", F.lit(True)).join(led.withColumn("_l", F.lit(True)), ["date", "sku"], "full_outer")
    su, lu = F.coalesce(c("source_units"), F.lit(0)), F.coalesce(c("ledger_units"), F.lit(0))
    return j.select("date", "sku", su.cast("bigint").alias("source_units"), lu.cast("bigint").alias("ledger_units"),
                    (lu - su).cast("bigint").alias("diff"),
                    F.when(c("_s").isNull(), "missing_in_source").when(c("_l").isNull(), "missing_in_ledger")
                     .when(lu == su, "match").otherwise("mismatch").alias("status"))


@query("p04_ledger_duplicate_keys", osql("fx_inventory", """
SELECT record_id, count(*) AS copies FROM fx_inventory GROUP BY record_id HAVING count(*) > 1"""))
def p04_ledger_duplicate_keys(spark, sf_dir):
    from larder.sources.fixtures import fx_inventory
    return fx_inventory(spark, sf_dir).groupBy("record_id").agg(F.count(F.lit(1)).alias("copies")).where(c("copies") > 1)


@query("p05_b2b_vs_pos", osql(["fx_b2b", "fx_pos"], """
, w AS (SELECT store_id, sku, sum(quantity_sold) AS wholesale_units, avg(price_per_unit) AS wholesale_price
        FROM fx_b2b WHERE store_id IS NOT NULL AND sku IS NOT NULL GROUP BY 1, 2),
r AS (SELECT retailer_id AS store_id, sku, sum(quantity_sold) AS retail_units, avg(price) AS retail_price
      FROM fx_pos WHERE retailer_id IS NOT NULL AND sku IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(w.store_id, r.store_id) AS store_id, coalesce(w.sku, r.sku) AS sku,
       coalesce(wholesale_units, 0) AS wholesale_units, coalesce(retail_units, 0) AS retail_units,
       round((retail_price - wholesale_price) * 100.0 / retail_price, 6) AS margin_pct
FROM w FULL OUTER JOIN r ON w.store_id = r.store_id AND w.sku = r.sku"""))
def p05_b2b_vs_pos(spark, sf_dir):
    from larder.sources.fixtures import fx_b2b, fx_pos
    w = report(fx_b2b(spark, sf_dir), ["store_id", "sku"],
               [F.sum("quantity_sold").alias("wholesale_units"), F.avg("price_per_unit").alias("wholesale_price")])
    r = report(fx_pos(spark, sf_dir).withColumnRenamed("retailer_id", "store_id"), ["store_id", "sku"],
               [F.sum("quantity_sold").alias("retail_units"), F.avg("price").alias("retail_price")])
    j = w.join(r, ["store_id", "sku"], "full_outer")
    return j.select("store_id", "sku", F.coalesce(c("wholesale_units"), F.lit(0.0)).alias("wholesale_units"),
                    F.coalesce(c("retail_units"), F.lit(0.0)).alias("retail_units"),
                    S.rnd(S.pct(c("retail_price") - c("wholesale_price"), "retail_price")).alias("margin_pct"))


@query("p06_route_scorecard", osql(["fx_dispatch", "fx_returns", "fx_waste"], """
, d AS (SELECT route_id, count(*) AS dispatches,
               avg((epoch_us(actual_arrival) - epoch_us(expected_arrival)) / 60000000.0) AS mean_delay
        FROM fx_dispatch WHERE route_id IS NOT NULL GROUP BY route_id),
r AS (SELECT route_id, sum(qty_returned) AS returned_units FROM fx_returns WHERE route_id IS NOT NULL GROUP BY route_id),
w AS (SELECT route_id, sum(qty_waste) AS wasted_units FROM fx_waste WHERE route_id IS NOT NULL GROUP BY route_id)
SELECT coalesce(d.route_id, r.route_id, w.route_id) AS route_id, coalesce(dispatches, 0) AS dispatches,
       round(mean_delay, 6) AS mean_delay, CAST(coalesce(returned_units, 0) AS BIGINT) AS returned_units,
       CAST(coalesce(wasted_units, 0) AS BIGINT) AS wasted_units
FROM d FULL OUTER JOIN r ON d.route_id = r.route_id
FULL OUTER JOIN w ON coalesce(d.route_id, r.route_id) = w.route_id"""))
def p06_route_scorecard(spark, sf_dir):
    d = report(dispatch_prepared(spark, sf_dir), "route_id",
               [F.count(F.lit(1)).alias("dispatches"), F.avg(DELAY).alias("mean_delay")])
    r = report(fx_returns(spark, sf_dir), "route_id", [F.sum("qty_returned").alias("returned_units")])
    w = report(fx_waste(spark, sf_dir), "route_id", [F.sum("qty_waste").alias("wasted_units")])
    j = d.join(r, "route_id", "full_outer").join(w, "route_id", "full_outer")
    return j.select("route_id", F.coalesce(c("dispatches"), F.lit(0)).alias("dispatches"),
                    S.rnd("mean_delay").alias("mean_delay"),
                    F.coalesce(c("returned_units"), F.lit(0)).cast("bigint").alias("returned_units"),
                    F.coalesce(c("wasted_units"), F.lit(0)).cast("bigint").alias("wasted_units"))


@query("p07_dispatch_without_sales", osql(["fx_dispatch", "fx_pos"], """
SELECT retailer_id, count(*) AS dispatches, CAST(sum(qty_dispatched) AS BIGINT) AS dispatched_units
FROM fx_dispatch d WHERE retailer_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fx_pos p WHERE p.retailer_id = d.retailer_id)
GROUP BY retailer_id"""))
def p07_dispatch_without_sales(spark, sf_dir):
    from larder.sources.fixtures import fx_pos
    sold = fx_pos(spark, sf_dir).select("retailer_id").where(c("retailer_id").isNotNull()).distinct()
    d = report(dispatch_prepared(spark, sf_dir), "retailer_id",
               [F.count(F.lit(1)).alias("dispatches"), S.sum0("qty_dispatched").alias("dispatched_units")])
    return d.join(sold, "retailer_id", "left_anti")


@query("p08_sales_by_retailer_type", osql(["fx_pos", "fx_retailer_master"], """
SELECT coalesce(m.retailer_type, 'UNMATCHED') AS retailer_type, count(*) AS transactions,
       sum(quantity_sold) AS units, count(DISTINCT p.retailer_id) AS retailers
FROM fx_pos p LEFT JOIN fx_retailer_master m ON p.retailer_id = m.retailer_id GROUP BY 1"""))
def p08_sales_by_retailer_type(spark, sf_dir):
    from larder.sources.fixtures import fx_pos
    master = fx_retailer_master(spark, sf_dir).select("retailer_id", "retailer_type")
    # One row per customer: the master grows with the data, so its measured size decides the join.
    j = fx_pos(spark, sf_dir).join(master, "retailer_id", "left")
    j = j.withColumn("retailer_type", F.coalesce(c("retailer_type"), F.lit("UNMATCHED")))
    return report(j, "retailer_type", [F.count(F.lit(1)).alias("transactions"), F.sum("quantity_sold").alias("units"),
                                       S.nunique("retailer_id").alias("retailers")])


@query("p10_pos_daily_lags", osql("fx_pos", """
, d AS (SELECT sku, CAST(timestamp AS DATE) AS date, sum(quantity_sold) AS units
        FROM fx_pos WHERE sku IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2)
SELECT sku, date, units, lag(units, 1) OVER w AS units_lag1, lag(units, 7) OVER w AS units_lag7
FROM d WINDOW w AS (PARTITION BY sku ORDER BY date)"""))
def p10_pos_daily_lags(spark, sf_dir):
    """Lag features on the SKU-daily aggregate (one row per SKU and day)."""
    d = report(pos_prepared(spark, sf_dir), ["sku", "date"], [F.sum("quantity_sold").alias("units")])
    w = Window.partitionBy("sku").orderBy("date")
    return d.select("sku", "date", "units", F.lag("units", 1).over(w).alias("units_lag1"),
                    F.lag("units", 7).over(w).alias("units_lag7"))


@query("p11_returns_to_waste", osql(["fx_returns", "fx_waste"], """
, r AS (SELECT sku, retailer_id, sum(qty_returned) AS returned FROM fx_returns
        WHERE sku IS NOT NULL AND retailer_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT sku, retailer_id, sum(qty_waste) AS wasted FROM fx_waste
      WHERE sku IS NOT NULL AND retailer_id IS NOT NULL GROUP BY 1, 2)
SELECT r.sku, r.retailer_id, CAST(returned AS BIGINT) AS returned_units, CAST(coalesce(wasted, 0) AS BIGINT) AS wasted_units,
       round(coalesce(wasted, 0) * 1.0 / returned, 6) AS wasted_per_returned
FROM r LEFT JOIN w ON r.sku = w.sku AND r.retailer_id = w.retailer_id"""))
def p11_returns_to_waste(spark, sf_dir):
    r = report(fx_returns(spark, sf_dir), ["sku", "retailer_id"], [F.sum("qty_returned").alias("returned")])
    w = report(fx_waste(spark, sf_dir), ["sku", "retailer_id"], [F.sum("qty_waste").alias("wasted")])
    j = r.join(w, ["sku", "retailer_id"], "left")
    wasted = F.coalesce(c("wasted"), F.lit(0))
    return j.select("sku", "retailer_id", c("returned").cast("bigint").alias("returned_units"),
                    wasted.cast("bigint").alias("wasted_units"),
                    S.rnd(S.ratio(wasted, "returned")).alias("wasted_per_returned"))


@query("p12_capacity_use", osql(["fx_dispatch", "fx_routes"], """
, d AS (SELECT vehicle_id, count(*) AS trips, sum(qty_dispatched) AS units FROM fx_dispatch GROUP BY vehicle_id),
v AS (SELECT vehicle_id, min(load_capacity_kg) AS capacity_kg FROM fx_routes GROUP BY vehicle_id)
SELECT d.vehicle_id, trips, CAST(units AS BIGINT) AS units, capacity_kg,
       round(units * 1.0 / trips / capacity_kg * 100, 6) AS avg_load_pct_of_capacity
FROM d JOIN v ON d.vehicle_id = v.vehicle_id"""))
def p12_capacity_use(spark, sf_dir):
    d = report(dispatch_prepared(spark, sf_dir), "vehicle_id",
               [F.count(F.lit(1)).alias("trips"), S.sum0("qty_dispatched").alias("units")])
    v = report(routes_prepared(spark, sf_dir), "vehicle_id", [F.min("load_capacity_kg").alias("capacity_kg")])
    j = d.join(v, "vehicle_id")
    return j.withColumn("avg_load_pct_of_capacity",
                        S.rnd(S.ratio(S.ratio("units", "trips"), "capacity_kg") * 100))


# Which reading belongs to a checked parameter, by its number modulo 5: fixed values.
CHECK_METRICS = ["view", "click", "purchase", "signup", "error"]
_METRIC_SQL = "CASE CAST(substr(parameter, 7) AS INT) % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(CHECK_METRICS)) + " END"


def qc_checks(spark, sf_dir):
    """QC checks with the plant that made the batch (its smallest name), the metric to look up, and the
    clock time of the check, moved into the month that the sensors cover."""
    plants = fx_production(spark, sf_dir).groupBy("batch_id").agg(F.min("plant").alias("plant_id"))
    metric = F.element_at(F.array(*[F.lit(m) for m in CHECK_METRICS]), (F.substring("parameter", 7, 9).cast("int") % 5 + 1).cast("int"))
    minute = (c("qc_id") * 7919 % 43200).cast("int")
    at = F.when(c("timestamp").isNotNull(), F.timestamp_add("MINUTE", minute, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))
    return (qc_prepared(spark, sf_dir).join(plants, "batch_id", "left")
            .select("qc_id", "batch_id", "plant_id", metric.alias("metric_name"), at.alias("check_time"), "status"))


_CHECKS_SQL = f"""
, m AS (SELECT batch_id, min(plant) AS plant_id FROM fx_production GROUP BY batch_id),
q AS (SELECT qc_id, q.batch_id, plant_id, {_METRIC_SQL} AS metric_name, lower(trim(pass_fail)) AS status,
             CASE WHEN timestamp IS NOT NULL THEN TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(qc_id * 7919 % 43200 AS INT) END AS check_time
      FROM fx_qc q LEFT JOIN m ON q.batch_id = m.batch_id),
s AS (SELECT plant_id, metric_name, timestamp, max(sensor_id) AS sensor_id, arg_max(metric_value, sensor_id) AS sensor_value
      FROM fx_sensors WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT q.*, s.sensor_id, s.sensor_value, epoch_us(q.check_time) - epoch_us(s.timestamp) AS age_micros
      FROM q ASOF LEFT JOIN s ON q.plant_id = s.plant_id AND q.metric_name = s.metric_name AND q.check_time >= s.timestamp)
"""


def _readings_at_checks(spark, sf_dir, *columns):
    """The checks' ``columns`` with the last reading; the joined checks are written once, as the as-of join reads them in several passes."""
    from larder.operators.asof import asof_join
    from larder.operators.stages import written
    from larder.sources.fixtures import fx_sensors
    readings = (fx_sensors(spark, sf_dir).where(c("metric_value").isNotNull())
                .select("plant_id", "metric_name", c("timestamp").alias("read_at"), "sensor_id", c("metric_value").alias("sensor_value")))
    checks = written(qc_checks(spark, sf_dir).select(*columns), "checks")
    out = asof_join(checks, readings, ["plant_id", "metric_name"], "check_time", "read_at", "sensor_id", ["read_at", "sensor_id", "sensor_value"])
    return out.withColumn("age_micros", F.timestamp_diff("MICROSECOND", c("read_at"), c("check_time"))).drop("read_at")


@query("p03_qc_sensor_asof", osql(["fx_qc", "fx_production", "fx_sensors"], _CHECKS_SQL + """
SELECT qc_id, batch_id, plant_id, metric_name, status, check_time, sensor_id, sensor_value, age_micros FROM a"""))
def p03_qc_sensor_asof(spark, sf_dir):
    """Each QC check with the last reading of its plant and metric at or before it."""
    return _readings_at_checks(spark, sf_dir, "qc_id", "batch_id", "plant_id", "metric_name", "check_time", "status")


@query("p03_reading_by_status", osql(["fx_qc", "fx_production", "fx_sensors"], _CHECKS_SQL + """
SELECT metric_name, status, count(*) AS checks, count(sensor_id) AS with_reading, round(avg(sensor_value), 6) AS mean_reading,
       round(stddev_samp(sensor_value), 6) AS std_reading, max(age_micros) AS oldest_micros
FROM a GROUP BY metric_name, status"""))
def p03_reading_by_status(spark, sf_dir):
    """Readings at failed and passed checks."""
    return _readings_at_checks(spark, sf_dir, "plant_id", "metric_name", "check_time", "status").groupBy("metric_name", "status").agg(
        F.count(F.lit(1)).alias("checks"), F.count("sensor_id").alias("with_reading"), S.rnd(F.avg("sensor_value")).alias("mean_reading"),
        S.rnd(F.stddev_samp("sensor_value")).alias("std_reading"), F.max("age_micros").alias("oldest_micros"))


__all__ = ["b2b_prepared"]


# Holiday calendar of the fixtures (FIXTURES.md "small inline tables"): fixed values.
HOLIDAYS = [("1995-12-25", "Christmas"), ("1996-01-01", "New Year"), ("1996-12-25", "Christmas"),
            ("1997-07-04", "Summer Fair"), ("1998-12-25", "Christmas"), ("1999-01-01", "New Year"),
            ("2000-04-24", "Spring Holiday"), ("2001-01-01", "New Year")]
_HOL_SQL = ", ".join(f"(DATE '{d}', '{n}')" for d, n in HOLIDAYS)


@query("p09_holiday_effects", osql("fx_pos", f"""
, d AS (SELECT CAST(timestamp AS DATE) AS date, sum(quantity_sold) AS units FROM fx_pos
        WHERE timestamp IS NOT NULL GROUP BY 1),
h AS (SELECT * FROM (VALUES {_HOL_SQL}) t(holiday_date, holiday_name))
SELECT holiday_date, holiday_name,
       round(avg(units) FILTER (WHERE date < holiday_date), 6) AS before_avg_units,
       max(units) FILTER (WHERE date = holiday_date) AS during_units,
       round(avg(units) FILTER (WHERE date > holiday_date), 6) AS after_avg_units
FROM h LEFT JOIN d ON d.date BETWEEN holiday_date - INTERVAL 3 DAY AND holiday_date + INTERVAL 3 DAY
GROUP BY holiday_date, holiday_name"""))
def p09_holiday_effects(spark, sf_dir):
    """Demand 3 days before, on, and 3 days after each holiday.

    The range join pairs the daily aggregate (one row per day) with the
    holiday dimension (a handful of rows, broadcast), never fact rows.
    """
    daily = report(pos_prepared(spark, sf_dir), "date", [F.sum("quantity_sold").alias("units")])
    hol = F.broadcast(spark.createDataFrame(HOLIDAYS, "d string, holiday_name string")
                      .select(F.to_date("d").alias("holiday_date"), "holiday_name"))
    h = c("holiday_date")
    j = hol.join(daily, c("date").between(F.date_sub(h, 3), F.date_add(h, 3)), "left")
    return j.groupBy("holiday_date", "holiday_name").agg(
        S.rnd(F.avg(F.when(c("date") < h, c("units")))).alias("before_avg_units"),
        F.max(F.when(c("date") == h, c("units"))).alias("during_units"),
        S.rnd(F.avg(F.when(c("date") > h, c("units")))).alias("after_avg_units"))
