"""Wholesale (B2B) sales reports: C10-C12, C34, A16, A21, A27, R25-R38."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.quantiles import exact_quantiles
from larder.operators.ranking import top_shares
from larder.operators.report import report
from larder.operators.stages import if_small, written
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_b2b

c = F.col
Q = "quantity_sold"
REQUIRED = ["timestamp", "store_id", "sku", Q]


def b2b_rows(spark, sf_dir) -> DataFrame:
    """The rows that have the required columns."""
    return fx_b2b(spark, sf_dir).dropna(subset=REQUIRED)


def _named(df: DataFrame) -> DataFrame:
    """C11 constant fills, calendar fields, C34 depot region."""
    df = df.fillna({"depot_id": "DIRECT", "route_id": "UNKNOWN"})
    ts = c("timestamp")
    return df.withColumns({"date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": S.day_name(ts), "depot_region": D.depot_region("depot_id")})


def b2b_units(spark, sf_dir) -> DataFrame:
    """The prepared rows without prices, for reports of units: no median is looked for."""
    return _named(b2b_rows(spark, sf_dir).drop("price_per_unit"))


def priced(rows: DataFrame) -> DataFrame:
    """A missing price is the exact median of its SKU's prices.

    Prices differ from row to row, so a SKU's median comes from the rank selection, whose shuffles
    carry bins, not from a buffer of all its prices. ``rows`` are read in several passes: give a written table.
    """
    med = exact_quantiles(rows, ["sku"], "price_per_unit", [0.5], ["_sku_median"], stored=True).drop("n")
    filled = F.coalesce(c("price_per_unit"), c("_sku_median"))
    return rows.join(if_small(written(med, "sku-medians")), "sku", "left").withColumn("price_per_unit", filled).drop("_sku_median")


def b2b_prepared(spark, sf_dir) -> DataFrame:
    """C10 drop rows missing required columns, C11 constant fills, C12 SKU-median
    price fill, C22 revenue, C34 depot region.

    The joined rows are written once: the passes of the medians and the report read them.
    """
    df = _named(priced(written(b2b_rows(spark, sf_dir), "b2b-rows")))
    return df.withColumn("revenue", c(Q) * c("price_per_unit"))


B2B_SQL = """WITH b0 AS (
  SELECT * FROM fx_b2b WHERE timestamp IS NOT NULL AND store_id IS NOT NULL AND sku IS NOT NULL AND quantity_sold IS NOT NULL),
med AS (SELECT sku AS m_sku, median(price_per_unit) AS m FROM b0 GROUP BY sku),
b AS (
  SELECT timestamp, store_id, coalesce(depot_id, 'DIRECT') AS depot_id, sku, quantity_sold,
         coalesce(route_id, 'UNKNOWN') AS route_id, coalesce(price_per_unit, m) AS price_per_unit,
         CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour, dayname(timestamp) AS day_of_week,
         quantity_sold * coalesce(price_per_unit, m) AS revenue,
         CASE WHEN strpos(coalesce(depot_id, 'DIRECT'), '_') > 0 THEN split_part(coalesce(depot_id, 'DIRECT'), '_', 1)
              ELSE 'DIRECT' END AS depot_region
  FROM b0 LEFT JOIN med ON b0.sku = med.m_sku)
"""


def _bsql(body):
    return osql("fx_b2b", B2B_SQL + body)


_MONEY = "round(sum(revenue), 2)"


def _mode_sql(key, val="depot_id"):
    return f""", md AS (SELECT {key}, {val}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {val}) AS rk
          FROM b WHERE {val} IS NOT NULL GROUP BY {key}, {val})"""


@query("r25_b2b_by_depot", _bsql(f"""
SELECT depot_id, sum(quantity_sold) AS total_units, count(quantity_sold) AS orders,
       round(avg(quantity_sold), 6) AS avg_order_size, {_MONEY} AS revenue, count(DISTINCT store_id) AS stores_served,
       count(DISTINCT route_id) AS routes_used, count(DISTINCT sku) AS sku_variety
FROM b GROUP BY depot_id"""))
def r25_b2b_by_depot(spark, sf_dir):
    return report(b2b_prepared(spark, sf_dir), "depot_id", [
        F.sum(Q).alias("total_units"), F.count(Q).alias("orders"), S.rnd(F.avg(Q)).alias("avg_order_size"),
        S.money_sum("revenue").alias("revenue"), S.nunique("store_id").alias("stores_served"),
        S.nunique("route_id").alias("routes_used"), S.nunique("sku").alias("sku_variety")],
        order=[c("total_units").desc()])


@query("r26_b2b_by_store_top50", _bsql(_mode_sql("store_id") + f"""
SELECT b.store_id, sum(quantity_sold) AS total_units, count(quantity_sold) AS orders,
       round(avg(quantity_sold), 6) AS avg_order_size, {_MONEY} AS revenue,
       any_value(md.depot_id) AS primary_depot, count(DISTINCT sku) AS sku_variety
FROM b LEFT JOIN md ON md.store_id = b.store_id AND md.rk = 1
GROUP BY b.store_id ORDER BY total_units DESC, b.store_id LIMIT 50"""))
def r26_b2b_by_store_top50(spark, sf_dir):
    return report(b2b_prepared(spark, sf_dir), "store_id", [
        F.sum(Q).alias("total_units"), F.count(Q).alias("orders"), S.rnd(F.avg(Q)).alias("avg_order_size"),
        S.money_sum("revenue").alias("revenue"), S.mode_det("depot_id").alias("primary_depot"),
        S.nunique("sku").alias("sku_variety")], order=[c("total_units").desc()], limit=50)


@query("r27_b2b_by_route_top30", _bsql(_mode_sql("route_id") + f"""
SELECT b.route_id, sum(quantity_sold) AS total_units, count(quantity_sold) AS trips,
       round(avg(quantity_sold), 6) AS avg_units_per_trip, {_MONEY} AS revenue,
       count(DISTINCT store_id) AS stores_served, any_value(md.depot_id) AS primary_depot
FROM b LEFT JOIN md ON md.route_id = b.route_id AND md.rk = 1
GROUP BY b.route_id ORDER BY total_units DESC, b.route_id LIMIT 30"""))
def r27_b2b_by_route_top30(spark, sf_dir):
    return report(b2b_prepared(spark, sf_dir), "route_id", [
        F.sum(Q).alias("total_units"), F.count(Q).alias("trips"), S.rnd(F.avg(Q)).alias("avg_units_per_trip"),
        S.money_sum("revenue").alias("revenue"), S.nunique("store_id").alias("stores_served"),
        S.mode_det("depot_id").alias("primary_depot")], order=[c("total_units").desc()], limit=30)


@query("r28_b2b_by_sku", _bsql(f"""
SELECT sku, sum(quantity_sold) AS total_units, {_MONEY} AS revenue, round(avg(price_per_unit), 6) AS avg_wholesale_price,
       count(DISTINCT store_id) AS stores_ordering, count(DISTINCT depot_id) AS depots_stocking
FROM b GROUP BY sku"""))
def r28_b2b_by_sku(spark, sf_dir):
    return report(b2b_prepared(spark, sf_dir), "sku", [
        F.sum(Q).alias("total_units"), S.money_sum("revenue").alias("revenue"),
        S.rnd(F.avg("price_per_unit")).alias("avg_wholesale_price"),
        S.nunique("store_id").alias("stores_ordering"), S.nunique("depot_id").alias("depots_stocking")],
        order=[c("total_units").desc()])


@query("r29_b2b_by_date", _bsql(f"""
SELECT date, sum(quantity_sold) AS total_units, {_MONEY} AS revenue, count(DISTINCT store_id) AS stores_ordering,
       count(DISTINCT depot_id) AS depots_active FROM b GROUP BY date"""))
def r29_b2b_by_date(spark, sf_dir):
    return report(b2b_prepared(spark, sf_dir), "date", [
        F.sum(Q).alias("total_units"), S.money_sum("revenue").alias("revenue"),
        S.nunique("store_id").alias("stores_ordering"), S.nunique("depot_id").alias("depots_active")])


# Depot ids of the wholesale fixture: D1_Branch .. D10_Branch plus DIRECT (fill value).
MAX_DEPOTS = 500
DEPOTS = [f"D{i}_Branch" for i in range(1, 11)] + ["DIRECT"]


@query("r30_b2b_depot_sku_matrix", _bsql("SELECT sku, " + ", ".join(
    f"""coalesce(sum(quantity_sold) FILTER (WHERE depot_id = '{d}'), 0) AS "{d}\"""" for d in DEPOTS)
    + " FROM b GROUP BY sku"))
def r30_b2b_depot_sku_matrix(spark, sf_dir):
    from larder.operators.pivot import pivot_sum
    b = b2b_units(spark, sf_dir)
    # Depots beyond the known list widen the matrix; none is left out.
    seen = [r[0] for r in fx_b2b(spark, sf_dir).select("depot_id").where(c("depot_id").isNotNull()).distinct().limit(MAX_DEPOTS + 1).collect()]
    if len(seen) > MAX_DEPOTS:
        raise ValueError(f"more than {MAX_DEPOTS} depots: too many for columns, use r25_b2b_by_depot")
    return pivot_sum(b, "sku", "depot_id", DEPOTS + sorted(set(seen) - set(DEPOTS)), Q)


@query("r31_b2b_route_store_network", _bsql("""
, md AS (SELECT route_id, store_id, depot_id,
                row_number() OVER (PARTITION BY route_id, store_id ORDER BY count(*) DESC, depot_id) AS rk
         FROM b GROUP BY route_id, store_id, depot_id)
SELECT b.route_id, b.store_id, sum(quantity_sold) AS total_units, any_value(md.depot_id) AS primary_depot
FROM b LEFT JOIN md ON md.route_id = b.route_id AND md.store_id = b.store_id AND md.rk = 1
GROUP BY b.route_id, b.store_id"""))
def r31_b2b_route_store_network(spark, sf_dir):
    return report(b2b_units(spark, sf_dir), ["route_id", "store_id"], [
        F.sum(Q).alias("total_units"), S.mode_det("depot_id").alias("primary_depot")],
        order=[c("total_units").desc()])


@query("r32_b2b_overview", _bsql(f"""
SELECT count(*) AS orders, sum(quantity_sold) AS total_units, {_MONEY} AS total_revenue,
       count(DISTINCT store_id) AS stores, count(DISTINCT depot_id) AS depots, count(DISTINCT route_id) AS routes,
       count(DISTINCT sku) AS skus, round(avg(quantity_sold), 6) AS avg_order_size,
       round(avg(revenue), 6) AS avg_order_value, round(avg(price_per_unit), 6) AS avg_price
FROM b"""))
def r32_b2b_overview(spark, sf_dir):
    df = b2b_prepared(spark, sf_dir)
    return df.agg(
        F.count(F.lit(1)).alias("orders"), F.sum(Q).alias("total_units"), S.money_sum("revenue").alias("total_revenue"),
        S.nunique("store_id").alias("stores"), S.nunique("depot_id").alias("depots"),
        S.nunique("route_id").alias("routes"), S.nunique("sku").alias("skus"),
        S.rnd(F.avg(Q)).alias("avg_order_size"), S.rnd(F.avg("revenue")).alias("avg_order_value"),
        S.rnd(F.avg("price_per_unit")).alias("avg_price"))


@query("r33_b2b_depot_concentration", _bsql("""
, g AS (SELECT depot_id, sum(quantity_sold) AS units FROM b GROUP BY depot_id),
s AS (SELECT depot_id, units, units * 100.0 / sum(units) OVER () AS share,
             row_number() OVER (ORDER BY units DESC, depot_id) AS rk FROM g)
SELECT round(sum(share) FILTER (WHERE rk <= 3), 6) AS top3_share_pct,
       round(sum(share) FILTER (WHERE rk <= 5), 6) AS top5_share_pct,
       sum(share) FILTER (WHERE rk <= 3) > 60 AS concentration_alert, count(*) AS depots FROM s"""))
def r33_b2b_depot_concentration(spark, sf_dir):
    """A20 shares and A21 top-k concentration, on the per-depot aggregate."""
    g = report(b2b_units(spark, sf_dir), "depot_id", [F.sum(Q).alias("units")])
    top = top_shares(g, "units", "depot_id", [3, 5])
    return top.select(S.rnd("top3").alias("top3_share_pct"), S.rnd("top5").alias("top5_share_pct"), (c("top3") > 60).alias("concentration_alert"), c("keys").alias("depots"))


@query("r34_b2b_store_order_profile", _bsql("""
, s AS (SELECT store_id, avg(quantity_sold) AS avg_order, count(*) AS orders FROM b GROUP BY store_id),
q AS (SELECT quantile_cont(avg_order, 0.75) AS p75 FROM s)
SELECT round(avg(avg_order), 6) AS mean_store_avg_order, round(avg(orders), 6) AS mean_orders_per_store,
       count(*) FILTER (WHERE avg_order >= p75) AS top_quartile_stores FROM s, q"""))
def r34_b2b_store_order_profile(spark, sf_dir):
    s = report(b2b_units(spark, sf_dir), "store_id", [F.avg(Q).alias("avg_order"), F.count(F.lit(1)).alias("orders")])
    p75 = s.agg(F.percentile("avg_order", 0.75).alias("p75"))
    return s.crossJoin(F.broadcast(p75)).agg(
        S.rnd(F.avg("avg_order")).alias("mean_store_avg_order"), S.rnd(F.avg("orders")).alias("mean_orders_per_store"),
        F.count_if(c("avg_order") >= c("p75")).alias("top_quartile_stores"))


@query("r35_b2b_route_efficiency", _bsql("""
, r AS (SELECT route_id, avg(quantity_sold) AS u FROM b WHERE route_id <> 'UNKNOWN' GROUP BY route_id)
SELECT round(avg(u), 6) AS mean_units_per_trip, arg_max(route_id, (u, route_id)) AS best_route,
       arg_min(route_id, (u, route_id)) AS worst_route, round(stddev_samp(u), 6) AS std_units_per_trip,
       stddev_samp(u) > 50 AS variability_alert FROM r"""))
def r35_b2b_route_efficiency(spark, sf_dir):
    r = report(b2b_units(spark, sf_dir).where(c("route_id") != "UNKNOWN"), "route_id", [F.avg(Q).alias("u")])
    return r.agg(S.rnd(F.avg("u")).alias("mean_units_per_trip"),
                 F.max_by("route_id", F.struct("u", "route_id")).alias("best_route"),
                 F.min_by("route_id", F.struct("u", "route_id")).alias("worst_route"),
                 S.rnd(F.stddev_samp("u")).alias("std_units_per_trip"),
                 (F.stddev_samp("u") > 50).alias("variability_alert"))


@query("r36_b2b_sku_coverage", _bsql("""
SELECT sku, count(DISTINCT store_id) AS stores_ordering,
       round(count(DISTINCT store_id) * 100.0 / (SELECT count(DISTINCT store_id) FROM b), 6) AS coverage_pct
FROM b GROUP BY sku"""))
def r36_b2b_sku_coverage(spark, sf_dir):
    df = b2b_units(spark, sf_dir)
    g = report(df, "sku", [S.nunique("store_id").alias("stores_ordering")])
    total = df.agg(S.nunique("store_id").alias("_stores"))
    return g.crossJoin(F.broadcast(total)).select(
        "sku", "stores_ordering", S.rnd(S.pct("stores_ordering", "_stores")).alias("coverage_pct"))


@query("r38_b2b_order_size_percentiles", _bsql("""
SELECT round(quantile_cont(quantity_sold, 0.1), 6) AS p10, round(quantile_cont(quantity_sold, 0.25), 6) AS p25,
       round(quantile_cont(quantity_sold, 0.5), 6) AS p50, round(quantile_cont(quantity_sold, 0.75), 6) AS p75,
       round(quantile_cont(quantity_sold, 0.95), 6) AS p95 FROM b"""))
def r38_b2b_order_size_percentiles(spark, sf_dir):
    wanted = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    q = exact_quantiles(b2b_units(spark, sf_dir), [], Q, list(wanted.values()), list(wanted))
    return q.select(*[S.rnd(n).alias(n) for n in wanted])


@query("c34_b2b_depot_region", _bsql("""
SELECT depot_region, sum(quantity_sold) AS total_units, count(DISTINCT depot_id) AS depots FROM b GROUP BY depot_region"""))
def c34_b2b_depot_region(spark, sf_dir):
    return report(b2b_units(spark, sf_dir), "depot_region",
                  [F.sum(Q).alias("total_units"), S.nunique("depot_id").alias("depots")])
