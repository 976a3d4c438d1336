"""Stock-ledger reports: C25-C28, R39-R52, A18, A30, A31, F03, F12."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.quantiles import add_quantiles, exact_quantiles
from larder.operators.ranking import with_rank
from larder.operators.report import report, with_share
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_inventory

c = F.col


def inventory_prepared(spark, sf_dir) -> DataFrame:
    """Ledger rows with a timestamp (C10), location (C25), reconciliation (C26),
    expiry (C27) and anomaly flags (C28)."""
    df = fx_inventory(spark, sf_dir).where(c("timestamp").isNotNull())
    ts = c("timestamp")
    calc = c("balance_before") + c("qty_in") - c("qty_out")
    days = S.floor_days("expiry_date", "timestamp")
    net = c("qty_in") - c("qty_out")
    return df.withColumns({
        "date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": S.day_name(ts), "day_no": S.weekday0(ts),
        "location_type": D.location_type(), "location_id": D.location_id(),
        "calculated_balance": calc,
        # NULL-safe inequality: a missing side counts as a mismatch only against a value.
        "balance_mismatch": ~c("balance_after").eqNullSafe(calc),
        "balance_diff": c("balance_after") - calc,
        "net_movement": net,
        "days_to_expiry": days,
        "expired_flag": days < 0,
        "expiry_risk": (F.when(days < 0, "Expired").when(days <= 2, "Critical")
                         .when(days <= 5, "Warning").otherwise("Safe")),
        "negative_balance_flag": c("balance_after") < 0,
        "large_adjustment_flag": (c("movement_type") == "stock_adjustment") & (F.abs(net) > 100),
    })


INV_SQL = """WITH inv AS (
  SELECT *, CAST(timestamp AS DATE) AS date, dayname(timestamp) AS day_of_week, isodow(timestamp) - 1 AS day_no,
         CASE WHEN plant_id IS NOT NULL THEN 'Plant' WHEN store_id IS NOT NULL THEN 'Store' ELSE 'Unknown' END AS location_type,
         coalesce(plant_id, store_id) AS location_id,
         balance_before + qty_in - qty_out AS calculated_balance,
         balance_after IS DISTINCT FROM (balance_before + qty_in - qty_out) AS balance_mismatch,
         qty_in - qty_out AS net_movement,
         CAST(floor((epoch_us(expiry_date) - epoch_us(timestamp)) / 86400000000.0) AS BIGINT) AS days_to_expiry,
         balance_after < 0 AS negative_balance_flag,
         movement_type = 'stock_adjustment' AND abs(qty_in - qty_out) > 100 AS large_adjustment_flag
  FROM fx_inventory WHERE timestamp IS NOT NULL),
inv2 AS (
  SELECT *, days_to_expiry < 0 AS expired_flag,
         CASE WHEN days_to_expiry < 0 THEN 'Expired' WHEN days_to_expiry <= 2 THEN 'Critical'
              WHEN days_to_expiry <= 5 THEN 'Warning' ELSE 'Safe' END AS expiry_risk
  FROM inv)
"""


def _isql(body):
    return osql("fx_inventory", INV_SQL + body)


_BASE_AGGS_SQL = """count(record_id) AS records, CAST(sum(qty_in) AS BIGINT) AS qty_in, CAST(sum(qty_out) AS BIGINT) AS qty_out"""


def _base_aggs():
    return [F.count("record_id").alias("records"), S.sum0("qty_in").alias("qty_in"), S.sum0("qty_out").alias("qty_out")]


@query("r39_inv_by_movement_type", _isql(f"""
SELECT movement_type, {_BASE_AGGS_SQL}, CAST(sum(net_movement) AS BIGINT) AS net_movement,
       round(avg(balance_after), 6) AS avg_balance
FROM inv2 WHERE movement_type IS NOT NULL GROUP BY movement_type"""))
def r39_inv_by_movement_type(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), "movement_type", _base_aggs() + [
        S.sum0("net_movement").alias("net_movement"), S.rnd(F.avg("balance_after")).alias("avg_balance")])


@query("r40_inv_by_location", _isql(f"""
SELECT location_type, location_id, {_BASE_AGGS_SQL}, round(avg(balance_after), 6) AS avg_balance,
       count(*) FILTER (WHERE negative_balance_flag) AS negative_balance_count
FROM inv2 WHERE location_type IS NOT NULL AND location_id IS NOT NULL GROUP BY location_type, location_id"""))
def r40_inv_by_location(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), ["location_type", "location_id"], _base_aggs() + [
        S.rnd(F.avg("balance_after")).alias("avg_balance"),
        F.count_if("negative_balance_flag").alias("negative_balance_count")], order=[c("records").desc()])


@query("r41_inv_by_sku", _isql(f"""
SELECT sku, {_BASE_AGGS_SQL}, CAST(sum(net_movement) AS BIGINT) AS net_movement,
       round(avg(balance_after), 6) AS avg_balance,
       arg_max(balance_after, (timestamp, record_id, balance_after)) AS latest_balance,
       count(*) FILTER (WHERE expired_flag) AS expired_movements,
       round(sum(qty_out) / (sum(qty_in) + 1), 6) AS turnover_ratio
FROM inv2 WHERE sku IS NOT NULL GROUP BY sku"""))
def r41_inv_by_sku(spark, sf_dir):
    g = report(inventory_prepared(spark, sf_dir), "sku", _base_aggs() + [
        S.sum0("net_movement").alias("net_movement"),
        S.rnd(F.avg("balance_after")).alias("avg_balance"),
        # Balance of the newest row (ties: higher record id, then higher balance).
        S.last_nonnull("balance_after", "timestamp", "record_id", "balance_after").alias("latest_balance"),
        F.count_if("expired_flag").alias("expired_movements")])
    return g.withColumn("turnover_ratio", S.rnd(S.ratio("qty_out", c("qty_in") + 1))).orderBy(c("latest_balance").desc())


@query("r42_inv_by_date", _isql(f"""
SELECT date, {_BASE_AGGS_SQL}, CAST(sum(net_movement) AS BIGINT) AS net_movement,
       round(avg(balance_after), 6) AS avg_balance, count(*) FILTER (WHERE negative_balance_flag) AS negative_balance_count
FROM inv2 GROUP BY date"""))
def r42_inv_by_date(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), "date", _base_aggs() + [
        S.sum0("net_movement").alias("net_movement"), S.rnd(F.avg("balance_after")).alias("avg_balance"),
        F.count_if("negative_balance_flag").alias("negative_balance_count")])


@query("r43_inv_expiry_risk", _isql(f"""
SELECT expiry_risk, {_BASE_AGGS_SQL}, count(DISTINCT sku) AS skus_affected FROM inv2 GROUP BY expiry_risk"""))
def r43_inv_expiry_risk(spark, sf_dir):
    return report(inventory_prepared(spark, sf_dir), "expiry_risk",
                  _base_aggs() + [S.nunique("sku").alias("skus_affected")])


@query("r44_inv_anomalies_top50", _isql("""
SELECT location_type, sku, count(record_id) AS negative_balance_count, min(balance_after) AS min_balance
FROM inv2 WHERE negative_balance_flag GROUP BY location_type, sku
ORDER BY negative_balance_count DESC, location_type, sku LIMIT 50"""))
def r44_inv_anomalies_top50(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir).where(c("negative_balance_flag"))
    return report(df, ["location_type", "sku"], [
        F.count("record_id").alias("negative_balance_count"), F.min("balance_after").alias("min_balance")],
        order=[c("negative_balance_count").desc()], limit=50)


@query("r45_inv_overview", _isql("""
SELECT count(*) AS records, count(DISTINCT sku) AS skus, count(DISTINCT plant_id) AS plants,
       count(DISTINCT store_id) AS stores, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
       CAST(sum(qty_in) AS BIGINT) AS total_qty_in, CAST(sum(qty_out) AS BIGINT) AS total_qty_out,
       CAST(sum(net_movement) AS BIGINT) AS net_movement, round(avg(balance_after), 6) AS avg_balance,
       round(median(balance_after), 6) AS median_balance
FROM inv2"""))
def r45_inv_overview(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    g = df.agg(
        F.count(F.lit(1)).alias("records"), S.nunique("sku").alias("skus"), S.nunique("plant_id").alias("plants"),
        S.nunique("store_id").alias("stores"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        S.sum0("qty_in").alias("total_qty_in"), S.sum0("qty_out").alias("total_qty_out"),
        S.sum0("net_movement").alias("net_movement"), S.rnd(F.avg("balance_after")).alias("avg_balance"))
    return add_quantiles(g, df, [], "balance_after", {"median_balance": 0.5})


@query("r45_inv_movement_mix", _isql("""
SELECT movement_type, count(*) AS records, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM inv2 WHERE movement_type IS NOT NULL GROUP BY movement_type"""))
def r45_inv_movement_mix(spark, sf_dir):
    g = report(inventory_prepared(spark, sf_dir), "movement_type", [F.count(F.lit(1)).alias("records")])
    return with_share(g, "records", "pct").withColumn("pct", S.rnd("pct"))


@query("r46_inv_integrity", _isql("""
SELECT count(*) FILTER (WHERE negative_balance_flag) AS negative_balances,
       round(avg(CAST(negative_balance_flag AS INT)) * 100, 6) AS negative_pct,
       count(*) FILTER (WHERE negative_balance_flag AND location_type = 'Plant') AS negative_at_plants,
       count(*) FILTER (WHERE negative_balance_flag AND location_type = 'Store') AS negative_at_stores,
       count(*) FILTER (WHERE balance_mismatch) AS mismatches,
       CAST(sum(abs(balance_after - calculated_balance)) FILTER (WHERE balance_mismatch) AS BIGINT) AS mismatch_abs_diff,
       count(*) FILTER (WHERE large_adjustment_flag) AS large_adjustments,
       round(count(*) FILTER (WHERE large_adjustment_flag) * 100.0
             / nullif(count(*) FILTER (WHERE movement_type = 'stock_adjustment'), 0), 6) AS large_adjustment_pct
FROM inv2"""))
def r46_inv_integrity(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    neg = c("negative_balance_flag")
    return df.agg(
        F.count_if(neg).alias("negative_balances"),
        S.rnd(S.rate(neg.cast("int"))).alias("negative_pct"),
        F.count_if(neg & (c("location_type") == "Plant")).alias("negative_at_plants"),
        F.count_if(neg & (c("location_type") == "Store")).alias("negative_at_stores"),
        F.count_if("balance_mismatch").alias("mismatches"),
        F.sum(F.when(c("balance_mismatch"), F.abs(c("balance_diff")))).alias("mismatch_abs_diff"),
        F.count_if("large_adjustment_flag").alias("large_adjustments"),
        S.rnd(S.pct(F.count_if("large_adjustment_flag"),
                    F.count_if(c("movement_type") == "stock_adjustment"))).alias("large_adjustment_pct"))


@query("r47_inv_location_flow", _isql("""
, g AS (SELECT location_type, count(record_id) AS records, sum(qty_in) AS qty_in, sum(qty_out) AS qty_out,
               sum(net_movement) AS net_movement, avg(balance_after) AS avg_balance,
               count(DISTINCT location_id) AS locations
        FROM inv2 GROUP BY location_type)
SELECT location_type, records, CAST(qty_in AS BIGINT) AS qty_in, CAST(qty_out AS BIGINT) AS qty_out,
       CAST(net_movement AS BIGINT) AS net_movement, round(avg_balance, 6) AS avg_balance, locations,
       round((SELECT qty_in FROM g WHERE location_type = 'Store') * 100.0
             / nullif((SELECT qty_out FROM g WHERE location_type = 'Plant'), 0), 6) AS flow_efficiency_pct
FROM g"""))
def r47_inv_location_flow(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    g = report(df, "location_type", _base_aggs() + [
        S.sum0("net_movement").alias("net_movement"), S.rnd(F.avg("balance_after")).alias("avg_balance"),
        S.nunique("location_id").alias("locations")])
    # Store inflow / plant outflow, from the same (3-row) aggregate.
    w = Window.partitionBy()
    store_in = F.max(F.when(c("location_type") == "Store", c("qty_in"))).over(w)
    plant_out = F.max(F.when(c("location_type") == "Plant", c("qty_out"))).over(w)
    return g.withColumn("flow_efficiency_pct", S.rnd(S.pct(store_in, plant_out)))


@query("r48_inv_sku_turnover", _isql("""
, g AS (SELECT sku, sum(qty_in) AS qty_in, sum(qty_out) AS qty_out, sum(net_movement) AS net_movement,
               count(record_id) AS movements,
               arg_max(balance_after, (timestamp, record_id, balance_after)) AS latest_balance
        FROM inv2 WHERE sku IS NOT NULL GROUP BY sku)
SELECT sku, CAST(qty_in AS BIGINT) AS qty_in, CAST(qty_out AS BIGINT) AS qty_out,
       CAST(net_movement AS BIGINT) AS net_movement, movements, latest_balance,
       round(qty_out / (qty_in + 1), 6) AS turnover_ratio,
       latest_balance > 1000 AND qty_out / (qty_in + 1) < 0.5 AS slow_moving,
       CAST(row_number() OVER (ORDER BY latest_balance DESC, sku) AS INT) AS balance_rank
FROM g"""))
def r48_inv_sku_turnover(spark, sf_dir):
    g = report(inventory_prepared(spark, sf_dir), "sku", [
        S.sum0("qty_in").alias("qty_in"), S.sum0("qty_out").alias("qty_out"),
        S.sum0("net_movement").alias("net_movement"), F.count("record_id").alias("movements"),
        S.last_nonnull("balance_after", "timestamp", "record_id", "balance_after").alias("latest_balance")])
    turnover = S.ratio("qty_out", c("qty_in") + 1)
    g = g.select(
        "sku", "qty_in", "qty_out", "net_movement", "movements", "latest_balance",
        S.rnd(turnover).alias("turnover_ratio"),
        # compound predicate.
        ((c("latest_balance") > 1000) & (turnover < 0.5)).alias("slow_moving"))
    return with_rank(g, [c("latest_balance").desc(), c("sku")], "balance_rank")


@query("r49_inv_expiry_days", _isql("""
SELECT count(days_to_expiry) AS n, count(*) FILTER (WHERE expired_flag) AS expired,
       round(avg(CAST(expired_flag AS INT)) * 100, 6) AS expired_pct,
       round(quantile_cont(days_to_expiry, 0.1), 6) AS p10, round(quantile_cont(days_to_expiry, 0.25), 6) AS p25,
       round(quantile_cont(days_to_expiry, 0.5), 6) AS p50, round(quantile_cont(days_to_expiry, 0.75), 6) AS p75,
       round(quantile_cont(days_to_expiry, 0.9), 6) AS p90, min(days_to_expiry) AS min_days, max(days_to_expiry) AS max_days
FROM inv2"""))
def r49_inv_expiry_days(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    g = df.agg(F.count("days_to_expiry").alias("n"), F.count_if("expired_flag").alias("expired"),
               S.rnd(S.rate(c("expired_flag").cast("int"))).alias("expired_pct"),
               F.min("days_to_expiry").alias("min_days"), F.max("days_to_expiry").alias("max_days"))
    return add_quantiles(g, df, [], "days_to_expiry", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


@query("r49_inv_expired_by_type", _isql("""
SELECT movement_type, count(*) AS expired_records FROM inv2
WHERE expired_flag AND movement_type IS NOT NULL GROUP BY movement_type"""))
def r49_inv_expired_by_type(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir).where(c("expired_flag"))
    return report(df, "movement_type", [F.count(F.lit(1)).alias("expired_records")])


@query("r50_inv_shrinkage", _isql("""
SELECT count(*) FILTER (WHERE movement_type = 'stock_adjustment') AS adjustment_records,
       CAST(coalesce(sum(qty_in) FILTER (WHERE movement_type = 'stock_adjustment'), 0) AS BIGINT) AS adjustments_in,
       CAST(coalesce(sum(qty_out) FILTER (WHERE movement_type = 'stock_adjustment'), 0) AS BIGINT) AS adjustments_out,
       CAST(coalesce(sum(net_movement) FILTER (WHERE movement_type = 'stock_adjustment'), 0) AS BIGINT) AS net_adjustment,
       round(CASE WHEN sum(qty_in) > 0 THEN abs(coalesce(sum(qty_out) FILTER (WHERE movement_type = 'stock_adjustment'), 0))
             * 100.0 / sum(qty_in) ELSE 0 END, 6) AS shrinkage_pct
FROM inv2"""))
def r50_inv_shrinkage(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    adj = c("movement_type") == "stock_adjustment"
    adj_out = F.coalesce(F.sum(F.when(adj, c("qty_out"))), F.lit(0))
    total_in = F.sum("qty_in")
    return df.agg(
        F.count_if(adj).alias("adjustment_records"),
        F.coalesce(F.sum(F.when(adj, c("qty_in"))), F.lit(0)).alias("adjustments_in"),
        adj_out.alias("adjustments_out"),
        F.coalesce(F.sum(F.when(adj, c("net_movement"))), F.lit(0)).alias("net_adjustment"),
        # Guard a zero inbound total.
        S.rnd(F.when(total_in > 0, F.abs(adj_out) * 100.0 / total_in).otherwise(F.lit(0.0))).alias("shrinkage_pct"))


@query("r50_inv_top_adjustment_reasons", _isql("""
SELECT reason_code, count(*) AS records FROM inv2
WHERE movement_type = 'stock_adjustment' AND reason_code IS NOT NULL GROUP BY reason_code
ORDER BY records DESC, reason_code LIMIT 5"""))
def r50_inv_top_adjustment_reasons(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir).where(c("movement_type") == "stock_adjustment")
    return report(df, "reason_code", [F.count(F.lit(1)).alias("records")], order=[c("records").desc()], limit=5)


@query("r51_inv_daily_averages", _isql("""
, d AS (SELECT date, sum(qty_in) AS qi, sum(qty_out) AS qo, sum(net_movement) AS nm, avg(balance_after) AS b
        FROM inv2 GROUP BY date)
SELECT round(avg(qi), 6) AS avg_daily_qty_in, round(avg(qo), 6) AS avg_daily_qty_out,
       round(avg(nm), 6) AS avg_daily_net, round(avg(b), 6) AS avg_daily_balance FROM d"""))
def r51_inv_daily_averages(spark, sf_dir):
    d = report(inventory_prepared(spark, sf_dir), "date", [
        F.sum("qty_in").alias("qi"), F.sum("qty_out").alias("qo"), F.sum("net_movement").alias("nm"),
        F.avg("balance_after").alias("b")])
    return d.agg(S.rnd(F.avg("qi")).alias("avg_daily_qty_in"), S.rnd(F.avg("qo")).alias("avg_daily_qty_out"),
                 S.rnd(F.avg("nm")).alias("avg_daily_net"), S.rnd(F.avg("b")).alias("avg_daily_balance"))


@query("r51_inv_weekday_peaks", _isql("""
, d AS (SELECT day_of_week, sum(qty_in) AS qi, sum(qty_out) AS qo FROM inv2 GROUP BY day_of_week)
SELECT arg_max(day_of_week, (qi, day_of_week)) AS peak_in_day, CAST(max(qi) AS BIGINT) AS peak_in,
       arg_max(day_of_week, (qo, day_of_week)) AS peak_out_day, CAST(max(qo) AS BIGINT) AS peak_out FROM d"""))
def r51_inv_weekday_peaks(spark, sf_dir):
    d = report(inventory_prepared(spark, sf_dir), "day_of_week",
               [F.sum("qty_in").alias("qi"), F.sum("qty_out").alias("qo")])
    return d.agg(F.max_by("day_of_week", F.struct("qi", "day_of_week")).alias("peak_in_day"),
                 F.max("qi").alias("peak_in"),
                 F.max_by("day_of_week", F.struct("qo", "day_of_week")).alias("peak_out_day"),
                 F.max("qo").alias("peak_out"))


@query("r52_inv_by_plant", osql("fx_inventory", """
SELECT plant_id, CAST(sum(qty_in) AS BIGINT) AS qty_in_sum, round(avg(qty_in), 6) AS qty_in_mean,
       CAST(sum(qty_out) AS BIGINT) AS qty_out_sum, round(avg(qty_out), 6) AS qty_out_mean,
       CAST(sum(balance_after) AS BIGINT) AS balance_sum, round(avg(balance_after), 6) AS balance_mean
FROM fx_inventory WHERE plant_id IS NOT NULL GROUP BY plant_id"""))
def r52_inv_by_plant(spark, sf_dir):
    # The basic report reads the raw ledger (no timestamp filter).
    return report(fx_inventory(spark, sf_dir), "plant_id", [
        S.sum0("qty_in").alias("qty_in_sum"), S.rnd(F.avg("qty_in")).alias("qty_in_mean"),
        S.sum0("qty_out").alias("qty_out_sum"), S.rnd(F.avg("qty_out")).alias("qty_out_mean"),
        S.sum0("balance_after").alias("balance_sum"), S.rnd(F.avg("balance_after")).alias("balance_mean")])


@query("f12_inv_balance_trimmed", _isql("""
, q AS (SELECT quantile_cont(balance_after, 0.01) AS lo, quantile_cont(balance_after, 0.99) AS hi FROM inv2)
SELECT count(*) AS rows_kept, round(avg(balance_after), 6) AS mean_balance, min(balance_after) AS min_balance,
       max(balance_after) AS max_balance
FROM inv2, q WHERE balance_after BETWEEN lo AND hi"""))
def f12_inv_balance_trimmed(spark, sf_dir):
    df = inventory_prepared(spark, sf_dir)
    q = exact_quantiles(df, [], "balance_after", [0.01, 0.99], ["_lo", "_hi"])  # one row
    kept = df.crossJoin(F.broadcast(q)).where(c("balance_after").between(c("_lo"), c("_hi")))
    return kept.agg(F.count(F.lit(1)).alias("rows_kept"), S.rnd(F.avg("balance_after")).alias("mean_balance"),
                    F.min("balance_after").alias("min_balance"), F.max("balance_after").alias("max_balance"))
