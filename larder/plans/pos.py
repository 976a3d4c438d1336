"""Retail (point-of-sale) reports: R12-R24, A24, A25, A27, W04."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.report import report, with_share
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_pos

c = F.col


def pos_prepared(spark, sf_dir) -> DataFrame:
    """fx_pos plus the derived calendar and revenue columns."""
    df = fx_pos(spark, sf_dir)
    ts = c("timestamp")
    return df.withColumns({
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "dayofweek": S.weekday0(ts),
        "day_name": S.day_name(ts),
        "is_weekend": S.is_weekend(ts).cast("int"),
        "revenue": c("quantity_sold") * c("price"),
        "promotion_category": F.coalesce(c("promotion_name"), F.lit("No Promotion")),
    })


# DuckDB twin of pos_prepared, appended as a CTE after fx_pos.
POS_SQL = """WITH pos AS (
  SELECT *, CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour,
         isodow(timestamp) - 1 AS dayofweek, dayname(timestamp) AS day_name,
         CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend,
         quantity_sold * price AS revenue,
         coalesce(promotion_name, 'No Promotion') AS promotion_category
  FROM fx_pos)
"""


def _pos_sql(body: str) -> str:
    return osql("fx_pos", POS_SQL + body)


# --- R13 ---------------------------------------------------------------------------------------
@query("r13_pos_by_region", _pos_sql("""
SELECT region,
       sum(quantity_sold) AS quantity_sold_sum,
       round(avg(quantity_sold), 6) AS quantity_sold_mean,
       round(sum(revenue), 2) AS revenue_sum,
       round(avg(revenue), 6) AS revenue_mean,
       count(sale_id) AS sale_id_count,
       count(DISTINCT retailer_id) AS retailer_id_nunique,
       CAST(sum(promotion_flag) AS BIGINT) AS promotion_flag_sum
FROM pos WHERE region IS NOT NULL GROUP BY region ORDER BY quantity_sold_sum DESC, region"""))
def r13_pos_by_region(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "region", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
        F.count("sale_id").alias("sale_id_count"),
        S.nunique("retailer_id").alias("retailer_id_nunique"),
        F.sum("promotion_flag").alias("promotion_flag_sum"),
    ], order=[c("quantity_sold_sum").desc()])


# --- R12 ---------------------------------------------------------------------------------------
@query("r12_pos_by_sku", _pos_sql("""
SELECT sku,
       sum(quantity_sold) AS quantity_sold_sum, round(avg(quantity_sold), 6) AS quantity_sold_mean,
       count(quantity_sold) AS quantity_sold_count,
       round(sum(revenue), 2) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean,
       round(min(price), 6) AS price_min, round(avg(price), 6) AS price_mean, round(max(price), 6) AS price_max,
       CAST(sum(promotion_flag) AS BIGINT) AS promotion_flag_sum
FROM pos WHERE sku IS NOT NULL GROUP BY sku"""))
def r12_pos_by_sku(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "sku", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        F.count("quantity_sold").alias("quantity_sold_count"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
        S.rnd(F.min("price")).alias("price_min"),
        S.rnd(F.avg("price")).alias("price_mean"),
        S.rnd(F.max("price")).alias("price_max"),
        F.sum("promotion_flag").alias("promotion_flag_sum"),
    ], order=[c("quantity_sold_sum").desc()])


# --- R14: first region = region of the lowest sale id (ties: smallest region) -------------------
@query("r14_pos_by_retailer_top50", _pos_sql("""
SELECT retailer_id,
       sum(quantity_sold) AS quantity_sold_sum, round(avg(quantity_sold), 6) AS quantity_sold_mean,
       round(sum(revenue), 2) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean,
       count(sale_id) AS sale_id_count, CAST(sum(promotion_flag) AS BIGINT) AS promotion_flag_sum,
       arg_min(region, (sale_id, region)) FILTER (WHERE region IS NOT NULL) AS region_first
FROM pos WHERE retailer_id IS NOT NULL GROUP BY retailer_id
ORDER BY quantity_sold_sum DESC, retailer_id LIMIT 50"""))
def r14_pos_by_retailer_top50(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "retailer_id", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
        F.count("sale_id").alias("sale_id_count"),
        F.sum("promotion_flag").alias("promotion_flag_sum"),
        S.first_nonnull("region", "sale_id", "region").alias("region_first"),
    ], order=[c("quantity_sold_sum").desc()], limit=50)


# --- R15 ---------------------------------------------------------------------------------------
@query("r15_pos_by_date", _pos_sql("""
SELECT date, sum(quantity_sold) AS total_units, round(sum(revenue), 2) AS total_revenue,
       count(sale_id) AS transactions, CAST(sum(promotion_flag) AS BIGINT) AS promo_transactions
FROM pos WHERE date IS NOT NULL GROUP BY date"""))
def r15_pos_by_date(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "date", [
        F.sum("quantity_sold").alias("total_units"),
        S.money_sum("revenue").alias("total_revenue"),
        F.count("sale_id").alias("transactions"),
        F.sum("promotion_flag").alias("promo_transactions"),
    ], order=[c("date").asc()])


# --- R16 ---------------------------------------------------------------------------------------
@query("r16_pos_by_hour", _pos_sql("""
SELECT hour, sum(quantity_sold) AS quantity_sold_sum, round(avg(quantity_sold), 6) AS quantity_sold_mean,
       count(quantity_sold) AS quantity_sold_count,
       round(sum(revenue), 2) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean
FROM pos WHERE hour IS NOT NULL GROUP BY hour"""))
def r16_pos_by_hour(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "hour", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        F.count("quantity_sold").alias("quantity_sold_count"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
    ], order=[c("hour").asc()])


# --- R17 (F01 equality filter pushed to the scan) ------------------------------------------------
@query("r17_pos_by_promotion", _pos_sql("""
SELECT promotion_name, sum(quantity_sold) AS quantity_sold_sum, round(avg(quantity_sold), 6) AS quantity_sold_mean,
       count(quantity_sold) AS quantity_sold_count,
       round(sum(revenue), 2) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean,
       round(avg(price), 6) AS price_mean, count(DISTINCT retailer_id) AS retailer_id_nunique
FROM pos WHERE promotion_flag = 1 AND promotion_name IS NOT NULL GROUP BY promotion_name"""))
def r17_pos_by_promotion(spark, sf_dir):
    df = pos_prepared(spark, sf_dir).where(c("promotion_flag") == 1)
    return report(df, "promotion_name", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        F.count("quantity_sold").alias("quantity_sold_count"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
        S.rnd(F.avg("price")).alias("price_mean"),
        S.nunique("retailer_id").alias("retailer_id_nunique"),
    ], order=[c("quantity_sold_sum").desc()])


# --- R18 (A02 two keys) ------------------------------------------------------------------------
@query("r18_pos_region_sku", _pos_sql("""
SELECT region, sku, sum(quantity_sold) AS quantity_sold, round(sum(revenue), 2) AS revenue
FROM pos WHERE region IS NOT NULL AND sku IS NOT NULL GROUP BY region, sku"""))
def r18_pos_region_sku(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), ["region", "sku"], [
        F.sum("quantity_sold").alias("quantity_sold"),
        S.money_sum("revenue").alias("revenue"),
    ], order=[c("quantity_sold").desc()])


# --- R19: overview, promotion mix and uplift (A39, A13, A24) in one global aggregate ---------------
@query("r19_pos_overview", _pos_sql("""
SELECT count(*) AS transactions, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
       sum(quantity_sold) AS total_units, round(sum(revenue), 2) AS total_revenue,
       round(avg(quantity_sold), 6) AS avg_units, round(avg(price), 6) AS avg_price,
       count(DISTINCT retailer_id) AS retailers, count(DISTINCT region) AS regions, count(DISTINCT sku) AS skus,
       CAST(sum(promotion_flag) AS BIGINT) AS promo_transactions,
       round(avg(promotion_flag) * 100, 6) AS promo_pct,
       count(DISTINCT promotion_name) FILTER (WHERE promotion_flag = 1) AS promotions,
       round((avg(quantity_sold) FILTER (WHERE promotion_flag = 1)
              / avg(quantity_sold) FILTER (WHERE promotion_flag = 0) - 1) * 100, 6) AS uplift_qty_pct,
       round((avg(revenue) FILTER (WHERE promotion_flag = 1)
              / avg(revenue) FILTER (WHERE promotion_flag = 0) - 1) * 100, 6) AS uplift_revenue_pct
FROM pos"""))
def r19_pos_overview(spark, sf_dir):
    df = pos_prepared(spark, sf_dir)
    promo, plain = c("promotion_flag") == 1, c("promotion_flag") == 0

    def cavg(x, cond):
        return F.avg(F.when(cond, c(x)))
    return df.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.sum("quantity_sold").alias("total_units"),
        S.money_sum("revenue").alias("total_revenue"),
        S.rnd(F.avg("quantity_sold")).alias("avg_units"),
        S.rnd(F.avg("price")).alias("avg_price"),
        S.nunique("retailer_id").alias("retailers"),
        S.nunique("region").alias("regions"),
        S.nunique("sku").alias("skus"),
        F.sum("promotion_flag").alias("promo_transactions"),
        S.rnd(S.rate("promotion_flag")).alias("promo_pct"),
        F.countDistinct(F.when(promo, c("promotion_name"))).alias("promotions"),
        S.rnd((S.ratio(cavg("quantity_sold", promo), cavg("quantity_sold", plain)) - 1) * 100)
         .alias("uplift_qty_pct"),
        S.rnd((S.ratio(cavg("revenue", promo), cavg("revenue", plain)) - 1) * 100).alias("uplift_revenue_pct"),
    )


# --- R20: SKU shares of the grand total (A20, A22) ----------------------------------------------
@query("r20_pos_sku_shares", _pos_sql("""
, s AS (SELECT sku, sum(quantity_sold) AS units, round(sum(revenue), 2) AS revenue,
               count(sale_id) AS transactions, round(avg(price), 6) AS avg_price
        FROM pos WHERE sku IS NOT NULL GROUP BY sku)
SELECT sku, units, revenue, transactions, avg_price,
       round(units / transactions, 6) AS units_per_transaction,
       round(units / sum(units) OVER () * 100, 6) AS units_share_pct,
       round(revenue / sum(revenue) OVER () * 100, 6) AS revenue_share_pct
FROM s"""))
def r20_pos_sku_shares(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "sku", [
        F.sum("quantity_sold").alias("units"),
        S.money_sum("revenue").alias("revenue"),
        F.count("sale_id").alias("transactions"),
        S.rnd(F.avg("price")).alias("avg_price"),
    ])
    g = with_share(with_share(g, "units", "units_share_pct"), "revenue", "revenue_share_pct")
    return g.select("sku", "units", "revenue", "transactions", "avg_price",
                    S.rnd(S.ratio("units", "transactions")).alias("units_per_transaction"),
                    S.rnd("units_share_pct").alias("units_share_pct"),
                    S.rnd("revenue_share_pct").alias("revenue_share_pct"))


@query("r20_pos_region_ratios", _pos_sql("""
SELECT region, sum(quantity_sold) AS units, round(sum(revenue), 2) AS revenue,
       count(sale_id) AS transactions, count(DISTINCT retailer_id) AS retailers,
       round(sum(quantity_sold) / count(sale_id), 6) AS units_per_transaction,
       round((round(sum(revenue), 2)) / count(sale_id), 6) AS revenue_per_transaction
FROM pos WHERE region IS NOT NULL GROUP BY region"""))
def r20_pos_region_ratios(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "region", [
        F.sum("quantity_sold").alias("units"),
        S.money_sum("revenue").alias("revenue"),
        F.count("sale_id").alias("transactions"),
        S.nunique("retailer_id").alias("retailers"),
    ])
    return g.withColumns({
        "units_per_transaction": S.rnd(S.ratio("units", "transactions")),
        "revenue_per_transaction": S.rnd(S.ratio("revenue", "transactions")),
    })


# --- R21: fast / slow movers from the mean of daily SKU totals (A23, T02, T03, F11) ---------------
@query("r21_pos_fast_slow_movers", _pos_sql("""
, d AS (SELECT date, sku, sum(quantity_sold) AS units FROM pos
        WHERE date IS NOT NULL AND sku IS NOT NULL GROUP BY date, sku),
m AS (SELECT sku, avg(units) AS daily_mean FROM d GROUP BY sku),
r AS (SELECT sku, daily_mean,
             row_number() OVER (ORDER BY daily_mean DESC, sku) AS fast_rank,
             row_number() OVER (ORDER BY daily_mean ASC, sku DESC) AS slow_rank,
             quantile_cont(daily_mean, 0.2) OVER () AS p20
      FROM m)
SELECT sku, round(daily_mean, 6) AS daily_units_mean, fast_rank,
       fast_rank <= 5 AS is_fast_top5, slow_rank <= 5 AS is_slow_bottom5, daily_mean < p20 AS below_p20
FROM r"""))
def r21_pos_fast_slow_movers(spark, sf_dir):
    daily = report(pos_prepared(spark, sf_dir), ["date", "sku"], [F.sum("quantity_sold").alias("units")])
    m = daily.groupBy("sku").agg(F.avg("units").alias("daily_mean"))
    w_all = Window.partitionBy()  # one row per SKU: a small aggregate
    return m.select(
        "sku", S.rnd("daily_mean").alias("daily_units_mean"),
        F.row_number().over(w_all.orderBy(c("daily_mean").desc(), c("sku"))).alias("fast_rank"),
        (F.row_number().over(w_all.orderBy(c("daily_mean").desc(), c("sku"))) <= 5).alias("is_fast_top5"),
        (F.row_number().over(w_all.orderBy(c("daily_mean").asc(), c("sku").desc())) <= 5).alias("is_slow_bottom5"),
        (c("daily_mean") < F.percentile("daily_mean", 0.2).over(w_all)).alias("below_p20"),
    )


# --- R22: weekday table on a Monday..Sunday dimension (J06), weekend split, hour extremes --------
def _weekday_dim(spark):
    # Seven fixed rows; broadcast is bounded by construction.
    return F.broadcast(spark.createDataFrame(
        [(i, n) for i, n in enumerate(S.WEEKDAY_NAMES)], "day_no int, day_name string"))


@query("r22_pos_weekday", _pos_sql("""
, dim AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                                 (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(day_no, day_name)),
g AS (SELECT dayofweek, sum(quantity_sold) AS units, round(sum(revenue), 2) AS revenue,
             count(sale_id) AS transactions FROM pos WHERE dayofweek IS NOT NULL GROUP BY dayofweek)
SELECT CAST(day_no AS INT) AS day_no, day_name, units, revenue, transactions
FROM dim LEFT JOIN g ON g.dayofweek = dim.day_no"""))
def r22_pos_weekday(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "dayofweek", [
        F.sum("quantity_sold").alias("units"),
        S.money_sum("revenue").alias("revenue"),
        F.count("sale_id").alias("transactions"),
    ])
    return (_weekday_dim(spark).join(g, c("day_no") == c("dayofweek"), "left")
            .select("day_no", "day_name", "units", "revenue", "transactions").orderBy("day_no"))


@query("r22_pos_weekend_vs_weekday", _pos_sql("""
SELECT CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS period,
       sum(quantity_sold) AS quantity_sold_sum, round(avg(quantity_sold), 6) AS quantity_sold_mean,
       round(sum(revenue), 2) AS revenue_sum, round(avg(revenue), 6) AS revenue_mean
FROM pos WHERE is_weekend IS NOT NULL GROUP BY is_weekend"""))
def r22_pos_weekend_vs_weekday(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "is_weekend", [
        F.sum("quantity_sold").alias("quantity_sold_sum"),
        S.rnd(F.avg("quantity_sold")).alias("quantity_sold_mean"),
        S.money_sum("revenue").alias("revenue_sum"),
        S.rnd(F.avg("revenue")).alias("revenue_mean"),
    ])
    return g.select(F.when(c("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("period"),
                    "quantity_sold_sum", "quantity_sold_mean", "revenue_sum", "revenue_mean")


@query("r22_pos_hour_extremes", _pos_sql("""
, h AS (SELECT hour, sum(quantity_sold) AS units FROM pos WHERE hour IS NOT NULL GROUP BY hour)
SELECT arg_max(hour, (units, -hour)) AS peak_hour, max(units) AS peak_units,
       arg_min(hour, (units, hour)) AS low_hour, min(units) AS low_units FROM h"""))
def r22_pos_hour_extremes(spark, sf_dir):
    h = report(pos_prepared(spark, sf_dir), "hour", [F.sum("quantity_sold").alias("units")])
    # idxmax / idxmin: first label on a tie, i.e. the smallest hour.
    return h.agg(
        F.max_by("hour", F.struct(c("units"), -c("hour"))).alias("peak_hour"),
        F.max("units").alias("peak_units"),
        F.min_by("hour", F.struct(c("units"), c("hour"))).alias("low_hour"),
        F.min("units").alias("low_units"),
    )


# --- R23: price statistics and price/quantity correlation per SKU (A25) ----------------------------
@query("r23_pos_price_stats", _pos_sql("""
SELECT sku, round(min(price), 6) AS min_price, round(avg(price), 6) AS avg_price,
       round(max(price), 6) AS max_price, round(stddev_samp(price), 6) AS std_price
FROM pos WHERE sku IS NOT NULL GROUP BY sku"""))
def r23_pos_price_stats(spark, sf_dir):
    return report(pos_prepared(spark, sf_dir), "sku", [
        S.rnd(F.min("price")).alias("min_price"),
        S.rnd(F.avg("price")).alias("avg_price"),
        S.rnd(F.max("price")).alias("max_price"),
        S.rnd(F.stddev_samp("price")).alias("std_price"),
    ])


@query("r23_pos_price_qty_corr", _pos_sql("""
, g AS (SELECT sku, corr(price, quantity_sold) AS r, count(*) AS n FROM pos
        WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 10)
SELECT sku, round(r, 6) AS price_qty_corr, n,
       CASE WHEN r < -0.3 THEN 'price_sensitive' WHEN r > 0.3 THEN 'premium' ELSE 'weak' END AS relationship
FROM g"""))
def r23_pos_price_qty_corr(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "sku",
               [F.corr("price", "quantity_sold").alias("r"), F.count(F.lit(1)).alias("n")],
               having=c("n") > 10)
    return g.select("sku", S.rnd("r").alias("price_qty_corr"), "n",
                    F.when(c("r") < -0.3, "price_sensitive").when(c("r") > 0.3, "premium")
                     .otherwise("weak").alias("relationship"))


# --- R24: top 20 retailers and retailers below the 10th percentile of transactions (F11) ------------
@query("r24_pos_top20_retailers", _pos_sql("""
SELECT retailer_id, sum(quantity_sold) AS units, round(sum(revenue), 2) AS revenue,
       count(sale_id) AS transactions, round(sum(quantity_sold) / count(sale_id), 6) AS units_per_transaction
FROM pos WHERE retailer_id IS NOT NULL GROUP BY retailer_id ORDER BY units DESC, retailer_id LIMIT 20"""))
def r24_pos_top20_retailers(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "retailer_id", [
        F.sum("quantity_sold").alias("units"),
        S.money_sum("revenue").alias("revenue"),
        F.count("sale_id").alias("transactions"),
    ], order=[c("units").desc()], limit=20)
    return g.withColumn("units_per_transaction", S.rnd(S.ratio("units", "transactions")))


@query("r24_pos_low_sales_retailers", _pos_sql("""
, g AS (SELECT retailer_id, count(sale_id) AS transactions FROM pos
        WHERE retailer_id IS NOT NULL GROUP BY retailer_id)
SELECT retailer_id, transactions FROM g
WHERE transactions < (SELECT quantile_cont(transactions, 0.1) FROM g)"""))
def r24_pos_low_sales_retailers(spark, sf_dir):
    g = report(pos_prepared(spark, sf_dir), "retailer_id", [F.count("sale_id").alias("transactions")])
    # The 10th percentile is one scalar over the per-retailer aggregate (one row per retailer).
    cut = g.agg(F.percentile("transactions", 0.1).alias("p10"))
    return g.crossJoin(F.broadcast(cut)).where(c("transactions") < c("p10")).select("retailer_id", "transactions")


# --- A27: SKU x region pivot of units (fill 0) ----------------------------------------------------
@query("a27_pos_sku_region_pivot", _pos_sql("""
SELECT sku,
       coalesce(sum(quantity_sold) FILTER (WHERE region = 'AFRICA'), 0) AS "AFRICA",
       coalesce(sum(quantity_sold) FILTER (WHERE region = 'AMERICA'), 0) AS "AMERICA",
       coalesce(sum(quantity_sold) FILTER (WHERE region = 'ASIA'), 0) AS "ASIA",
       coalesce(sum(quantity_sold) FILTER (WHERE region = 'EUROPE'), 0) AS "EUROPE",
       coalesce(sum(quantity_sold) FILTER (WHERE region = 'MIDDLE EAST'), 0) AS "MIDDLE EAST"
FROM pos WHERE sku IS NOT NULL GROUP BY sku"""))
def a27_pos_sku_region_pivot(spark, sf_dir):
    from larder.operators.pivot import pivot_sum
    from larder.sources.tables import read_table
    # Pivot columns come from the region dimension (5 rows), so the pivot is a
    # single pass of conditional sums rather than a distinct-values pre-job.
    regions = [r[0] for r in read_table(spark, sf_dir, "region").select("r_name").distinct().collect()]
    df = pos_prepared(spark, sf_dir)
    return pivot_sum(df, "sku", "region", sorted(regions), "quantity_sold")


# --- W04: centred 7-row moving average on the daily series ------------------------------------------
@query("w04_pos_daily_ma7", _pos_sql("""
, d AS (SELECT date, sum(quantity_sold) AS units FROM pos WHERE date IS NOT NULL GROUP BY date)
SELECT date, units,
       CASE WHEN count(units) OVER w = 7 THEN round(avg(units) OVER w, 6) END AS ma7
FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""))
def w04_pos_daily_ma7(spark, sf_dir):
    from larder.operators.windows import centered_moving_average
    daily = report(pos_prepared(spark, sf_dir), "date", [F.sum("quantity_sold").alias("units")])
    return centered_moving_average(daily, "date", "units", 7, "ma7")
