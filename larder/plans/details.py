"""Further parts of the reports: R36, R38, R52, R59, R71, R72, R78, R79, R86, A21, V01-V04, V08, P02, F13, F14.

``_grouped`` registers one grouped report with its SQL from the same short description.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.ranking import top_shares
from larder.operators.report import report
from larder.plans.b2b import _bsql, b2b_units
from larder.plans.dispatch import DELAY, _dsql, dispatch_prepared
from larder.plans.inventory import _isql, inventory_prepared
from larder.plans.oracle_views import osql
from larder.plans.production import _psql, production_prepared
from larder.plans.qc import _qsql, qc_prepared
from larder.plans.registry import query
from larder.plans.routes import _rsql, routes_prepared
from larder.sources.fixtures import DEFECT_COLUMNS, fx_inventory, fx_production, fx_returns, fx_waste

c = F.col


def _grouped(name, frame, sql_of, source, key, q, limit=None, share=False, key_expr=None, key_sql=None, where=None):
    """units, mean and records of ``q`` by ``key``; the largest ``limit``; ``share`` of all units."""
    ks = key_sql or key
    shares = f", round(sum({q}) * 100.0 / (SELECT sum({q}) FROM {source}), 6) AS share_pct" if share else ""
    tail = f" ORDER BY units DESC, {key} LIMIT {limit}" if limit else ""
    cond = f" AND {where[1]}" if where else ""

    @query(name, sql_of(f"""SELECT {ks} AS {key}, CAST(coalesce(sum({q}), 0) AS BIGINT) AS units, round(avg({q}), 6) AS mean_units, count(*) AS records{shares}
FROM {source} WHERE {ks} IS NOT NULL{cond} GROUP BY 1{tail}"""))
    def run(spark, sf_dir):
        df = frame(spark, sf_dir)
        part = df.where(where[0]()) if where else df
        part = part.withColumn(key, key_expr()) if key_expr else part
        g = report(part, key, [S.sum0(q).alias("units"), S.rnd(F.avg(q)).alias("mean_units"), F.count(F.lit(1)).alias("records")], order=[c("units").desc()], limit=limit)
        if share:
            g = g.crossJoin(F.broadcast(df.agg(F.sum(q).alias("_t")))).withColumn("share_pct", S.rnd(S.pct("units", "_t"))).drop("_t")  # one row
        return g
    run.__name__ = name


def _view(view):
    return lambda body: osql(view, body)


_day = {"key_expr": lambda: S.day_name(c("timestamp")), "key_sql": "dayname(timestamp)"}
_hour = {"key_expr": lambda: F.hour("timestamp"), "key_sql": "hour(timestamp)"}
_month = {"key_expr": lambda: F.date_format("timestamp", "yyyy-MM"), "key_sql": "strftime(timestamp, '%Y-%m')"}
W, R = "qty_waste", "qty_returned"
waste, returns = _view("fx_waste"), _view("fx_returns")
for k in ("plant_id", "waste_reason_code", "retailer_id"):
    _grouped(f"r72_waste_basic_by_{k}", fx_waste, waste, "fx_waste", k, W)
for k in ("retailer_id", "sku", "reason_code"):
    _grouped(f"r79_returns_basic_by_{k}", fx_returns, returns, "fx_returns", k, R)
_grouped("r71_waste_top10_reasons", fx_waste, waste, "fx_waste", "waste_reason_code", W, 10, True)
_grouped("r71_waste_top10_batches", fx_waste, waste, "fx_waste", "batch_id", W, 10, True)
_grouped("r71_waste_top15_routes", fx_waste, waste, "fx_waste", "route_id", W, 15, True)
_grouped("r71_waste_top15_retailers", fx_waste, waste, "fx_waste", "retailer_id", W, 15, True)
_grouped("r71_waste_stage_split", fx_waste, waste, "fx_waste", "stage", W, None, True)
_grouped("r71_waste_by_weekday", fx_waste, waste, "fx_waste", "day_of_week", W, None, True, **_day)
_grouped("r71_waste_by_hour", fx_waste, waste, "fx_waste", "hour", W, None, True, **_hour)
_grouped("r78_returns_reason_share", fx_returns, returns, "fx_returns", "reason_code", R, None, True)
_grouped("r78_returns_retailer_share_top15", fx_returns, returns, "fx_returns", "retailer_id", R, 15, True)
_grouped("r78_returns_sku_share", fx_returns, returns, "fx_returns", "sku", R, None, True)
_grouped("r78_returns_by_weekday", fx_returns, returns, "fx_returns", "day_of_week", R, None, True, **_day)
_grouped("r78_returns_monthly", fx_returns, returns, "fx_returns", "month", R, None, True, **_month)
_grouped("r59_prod_top10_lines", production_prepared, _psql, "prod", "line_id", "quantity_produced", 10, True)
_grouped("r59_prod_top10_skus", production_prepared, _psql, "prod", "sku", "quantity_produced", 10, True)
_grouped("v01_production_daily", production_prepared, _psql, "prod", "date", "quantity_produced", key_expr=lambda: F.to_date("timestamp"), key_sql="CAST(timestamp AS DATE)")
_grouped("v01_waste_daily", fx_waste, waste, "fx_waste", "date", W, key_expr=lambda: F.to_date("timestamp"), key_sql="CAST(timestamp AS DATE)")
_grouped("r38_b2b_by_weekday", b2b_units, _bsql, "b", "day_of_week", "quantity_sold", None, True)
_grouped("r38_b2b_by_hour", b2b_units, _bsql, "b", "hour", "quantity_sold", None, True)
_grouped("f13_inv_days_in_range", inventory_prepared, _isql, "inv2", "days_to_expiry", "balance_after",
         where=(lambda: c("days_to_expiry").between(-10, 30), "days_to_expiry BETWEEN -10 AND 30"))


def _top_shares(name, key):
    @query(name, _bsql(f"""
, g AS (SELECT {key}, sum(quantity_sold) AS u FROM b GROUP BY {key}),
s AS (SELECT u * 100.0 / sum(u) OVER () AS p, row_number() OVER (ORDER BY u DESC, {key}) AS r FROM g)
SELECT round(sum(p) FILTER (WHERE r <= 3), 6) AS top3_pct, round(sum(p) FILTER (WHERE r <= 5), 6) AS top5_pct, round(sum(p) FILTER (WHERE r <= 10), 6) AS top10_pct FROM s"""))
    def run(spark, sf_dir):
        g = report(b2b_units(spark, sf_dir), key, [F.sum("quantity_sold").alias("u")])
        return top_shares(g, "u", key, [3, 5, 10]).select(*[S.rnd(f"top{k}").alias(f"top{k}_pct") for k in (3, 5, 10)])


_top_shares("r36_b2b_sku_top_shares", "sku")
_top_shares("a21_b2b_depot_top_shares", "depot_id")


@query("r59_prod_defect_mix", _psql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS defect, CAST(sum({d}) AS BIGINT) AS defects, round(sum({d}) * 100.0 / (SELECT sum(total_defects) FROM prod), 6) AS share_pct FROM prod" for d in DEFECT_COLUMNS) + ") x"))
def r59_prod_defect_mix(spark, sf_dir):
    one = production_prepared(spark, sf_dir).agg(*[F.sum(d).alias(d) for d in DEFECT_COLUMNS], F.sum("total_defects").alias("_t"))
    long = one.unpivot(["_t"], DEFECT_COLUMNS, "defect", "defects")
    return long.select("defect", c("defects").cast("bigint").alias("defects"), S.rnd(S.pct("defects", "_t")).alias("share_pct"))


@query("r59_prod_batches_per_operator", _psql("""
SELECT round(avg(n), 6) AS mean_batches, min(n) AS min_batches, max(n) AS max_batches, count(*) AS operators
FROM (SELECT operator_id, count(DISTINCT batch_id) AS n FROM prod WHERE operator_id IS NOT NULL GROUP BY operator_id) g"""))
def r59_prod_batches_per_operator(spark, sf_dir):
    g = report(production_prepared(spark, sf_dir), "operator_id", [S.nunique("batch_id").alias("n")])
    return g.agg(S.rnd(F.avg("n")).alias("mean_batches"), F.min("n").alias("min_batches"), F.max("n").alias("max_batches"), F.count(F.lit(1)).alias("operators"))


def _ledger(name, key, limit=None):
    tail = f" ORDER BY qty_out_sum DESC, {key} LIMIT {limit}" if limit else ""

    @query(name, osql("fx_inventory", f"""
SELECT {key}, CAST(coalesce(sum(qty_in), 0) AS BIGINT) AS qty_in_sum, CAST(coalesce(sum(qty_out), 0) AS BIGINT) AS qty_out_sum, round(avg(balance_after), 6) AS balance_mean, count(*) AS records
FROM fx_inventory WHERE {key} IS NOT NULL GROUP BY {key}{tail}"""))
    def run(spark, sf_dir):
        return report(fx_inventory(spark, sf_dir), key, [S.sum0("qty_in").alias("qty_in_sum"), S.sum0("qty_out").alias("qty_out_sum"),
                                                         S.rnd(F.avg("balance_after")).alias("balance_mean"), F.count(F.lit(1)).alias("records")],
                      order=[c("qty_out_sum").desc()], limit=limit)


_ledger("r52_inv_sku_top50", "sku", 50)
_ledger("r52_inv_type_sums", "movement_type")


@query("v08_inv_weekday_net", _isql("""
SELECT day_of_week, CAST(sum(net_movement) AS BIGINT) AS net_units, count(*) AS records FROM inv2 GROUP BY day_of_week"""))
def v08_inv_weekday_net(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), "day_of_week", [F.sum("net_movement").alias("net_units"), F.count(F.lit(1)).alias("records")])


@query("v08_inv_flows_by_location_type", _isql("""
SELECT location_type, movement_type, CAST(sum(qty_in) AS BIGINT) AS units_in, CAST(sum(qty_out) AS BIGINT) AS units_out FROM inv2
WHERE movement_type IS NOT NULL GROUP BY location_type, movement_type"""))
def v08_inv_flows_by_location_type(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), ["location_type", "movement_type"], [F.sum("qty_in").alias("units_in"), F.sum("qty_out").alias("units_out")])


def _mix(key):
    @query(f"r86_routes_mix_by_{key}", _rsql(f"""
SELECT {key}, count(*) AS configurations, round(count(*) * 100.0 / (SELECT count(*) FROM rt), 6) AS share_pct, round(avg(distance_km), 6) AS mean_km,
       round(avg(estimated_time_minutes), 6) AS mean_minutes, round(avg(stops_count), 6) AS mean_stops, round(avg(risk_score), 6) AS mean_risk
FROM rt WHERE {key} IS NOT NULL GROUP BY {key}"""))
    def run(spark, sf_dir):
        df = routes_prepared(spark, sf_dir)
        g = report(df, key, [F.count(F.lit(1)).alias("configurations"), S.rnd(F.avg("distance_km")).alias("mean_km"), S.rnd(F.avg("estimated_time_minutes")).alias("mean_minutes"),
                             S.rnd(F.avg("stops_count")).alias("mean_stops"), S.rnd(F.avg("risk_score")).alias("mean_risk")])
        return g.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_t")))).withColumn("share_pct", S.rnd(S.pct("configurations", "_t"))).drop("_t")  # one row


for k in ("route_type", "load_capacity_kg", "region", "trip_start_window"):
    _mix(k)


@query("v01_dispatch_daily", _dsql("""
, g AS (SELECT CAST(timestamp AS DATE) AS date, count(*) AS dispatches, CAST(sum(qty_dispatched) AS BIGINT) AS units FROM d WHERE timestamp IS NOT NULL GROUP BY 1)
SELECT *, round(avg(dispatches) OVER (), 6) AS mean_dispatches FROM g"""))
def v01_dispatch_daily(spark, sf_dir):
    g = report(dispatch_prepared(spark, sf_dir).withColumn("date", F.to_date("timestamp")), "date", [F.count(F.lit(1)).alias("dispatches"), F.sum("qty_dispatched").cast("bigint").alias("units")])
    return g.withColumn("mean_dispatches", S.rnd(F.avg("dispatches").over(Window.partitionBy())))  # one row a day


@query("v02_qc_daily_fail_rate", _qsql("""
, g AS (SELECT date, round(avg(is_fail) * 100.0, 6) AS fail_rate FROM qc WHERE date IS NOT NULL GROUP BY date)
SELECT *, round(avg(fail_rate) OVER (), 4) AS mean_fail_rate FROM g"""))
def v02_qc_daily_fail_rate(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "date", [S.rnd(S.rate("is_fail")).alias("fail_rate")])
    return g.withColumn("mean_fail_rate", F.round(F.avg("fail_rate").over(Window.partitionBy()), 4))  # one row a day


@query("v03_on_time_by_route_top20", _dsql("""
SELECT route_id, count(*) AS trips, round(avg(on_time) * 100.0, 6) AS on_time_pct FROM d WHERE route_id IS NOT NULL GROUP BY route_id
HAVING count(*) >= 10 ORDER BY on_time_pct DESC, route_id LIMIT 20"""))
def v03_on_time_by_route_top20(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "route_id", [F.count(F.lit(1)).alias("trips"), S.rnd(S.rate("on_time")).alias("on_time_pct")],
                  having=c("trips") >= 10, order=[c("on_time_pct").desc()], limit=20)


@query("v03_worst_vehicles_15", _dsql("""
SELECT vehicle_id, count(*) AS trips, round(avg(dispatch_delay_minutes), 6) AS mean_delay FROM d WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id
HAVING count(*) >= 10 ORDER BY mean_delay DESC NULLS LAST, vehicle_id LIMIT 15"""))
def v03_worst_vehicles_15(spark, sf_dir):
    return report(dispatch_prepared(spark, sf_dir), "vehicle_id", [F.count(F.lit(1)).alias("trips"), S.rnd(F.avg(DELAY)).alias("mean_delay")],
                  having=c("trips") >= 10, order=[c("mean_delay").desc_nulls_last()], limit=15)


@query("v04_failed_batches_by_parameter", _qsql("""
SELECT parameter, count(DISTINCT batch_id) AS failed_batches FROM qc WHERE is_fail = 1 AND parameter IS NOT NULL GROUP BY parameter
ORDER BY failed_batches DESC, parameter LIMIT 10"""))
def v04_failed_batches_by_parameter(spark, sf_dir):
    return report(qc_prepared(spark, sf_dir).where(c("is_fail") == 1), "parameter", [S.nunique("batch_id").alias("failed_batches")], order=[c("failed_batches").desc()], limit=10)


@query("v04_checks_per_batch", _qsql("""
SELECT checks, count(*) AS batches FROM (SELECT batch_id, count(*) AS checks FROM qc WHERE batch_id IS NOT NULL GROUP BY batch_id) g GROUP BY checks"""))
def v04_checks_per_batch(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "batch_id", [F.count(F.lit(1)).alias("checks")])
    return g.groupBy("checks").agg(F.count(F.lit(1)).alias("batches"))


@query("f14_qc_parsable_values", _qsql("""
SELECT parameter, count(*) AS checks, count(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS parsable FROM qc WHERE parameter IS NOT NULL GROUP BY parameter"""))
def f14_qc_parsable_values(spark, sf_dir):
    return report(qc_prepared(spark, sf_dir), "parameter", [F.count(F.lit(1)).alias("checks"), F.count(c("value").cast("string").try_cast("double")).alias("parsable")])


@query("p02_qc_by_operator", osql(["fx_qc", "fx_production"], """
, q AS (SELECT batch_id, max(CAST(lower(trim(pass_fail)) = 'fail' AS INT)) AS any_fail FROM fx_qc WHERE batch_id IS NOT NULL GROUP BY batch_id),
p AS (SELECT DISTINCT batch_id, operator_id FROM fx_production WHERE operator_id IS NOT NULL)
SELECT operator_id, count(DISTINCT p.batch_id) AS batches, round(count(DISTINCT p.batch_id) FILTER (WHERE any_fail = 1) * 100.0 / count(DISTINCT p.batch_id), 6) AS failed_batch_pct
FROM p JOIN q ON p.batch_id = q.batch_id GROUP BY operator_id"""))
def p02_qc_by_operator(spark, sf_dir):
    q = report(qc_prepared(spark, sf_dir), "batch_id", [F.max("is_fail").alias("any_fail")])
    p = fx_production(spark, sf_dir).where(c("operator_id").isNotNull()).select("batch_id", "operator_id").distinct()
    failed = F.count_if(c("any_fail") == 1)  # one row a batch and operator
    return p.join(q, "batch_id").groupBy("operator_id").agg(F.count(F.lit(1)).alias("batches"), S.rnd(S.pct(failed, F.count(F.lit(1)))).alias("failed_batch_pct"))


@query("p10_derived_rates", osql(["fx_pos", "fx_b2b", "fx_waste"], """
, s AS (SELECT sku, sum(quantity_sold) AS sold FROM fx_pos WHERE sku IS NOT NULL GROUP BY sku),
b AS (SELECT sku, sum(quantity_sold) AS bought FROM fx_b2b WHERE sku IS NOT NULL GROUP BY sku),
w AS (SELECT sku, sum(qty_waste) AS wasted FROM fx_waste WHERE sku IS NOT NULL GROUP BY sku)
SELECT b.sku, round(sold / nullif(CAST(bought AS DOUBLE), 0), 6) AS sell_through_rate, round(coalesce(wasted, 0) / nullif(CAST(bought AS DOUBLE), 0), 6) AS waste_rate
FROM b LEFT JOIN s ON s.sku = b.sku LEFT JOIN w ON w.sku = b.sku"""))
def p10_derived_rates(spark, sf_dir):
    from larder.sources.fixtures import fx_b2b, fx_pos
    b = report(fx_b2b(spark, sf_dir), "sku", [F.sum("quantity_sold").alias("bought")])
    s = report(fx_pos(spark, sf_dir), "sku", [F.sum("quantity_sold").alias("sold")])
    w = report(fx_waste(spark, sf_dir), "sku", [F.sum("qty_waste").alias("wasted")])
    return b.join(s, "sku", "left").join(w, "sku", "left").select(
        "sku", S.rnd(S.ratio("sold", "bought")).alias("sell_through_rate"), S.rnd(S.ratio(F.coalesce("wasted", F.lit(0)), "bought")).alias("waste_rate"))
