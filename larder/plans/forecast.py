"""Promotion calendar effects (P09) and the SKU-daily forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators import forecast as O
from larder.operators.report import report
from larder.plans.oracle_views import osql
from larder.plans.pos import pos_prepared
from larder.plans.registry import query
from larder.sources.tables import read_table

c = F.col

NEAR = 7  # days before and after a promotion


def promotion_calendar(spark, sf_dir) -> DataFrame:
    """One day promotions, sixteen a brand of ``part``; every eighth pair of a brand lies two days apart."""
    brand = read_table(spark, sf_dir, "part").select(c("p_brand").alias("sku")).where(c("sku").isNotNull()).distinct()
    number = F.regexp_extract("sku", "([0-9]+)", 1).cast("int")
    k = c("k")
    day = (number * 13 + (k % 8) * 173) % 2000 + F.when(k >= 8, 2).otherwise(0)
    return brand.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        F.date_add(F.to_date(F.lit("1995-06-01")), day.cast("int")).alias("promo_date"), F.concat(F.lit("PROMO_"), k.cast("string")).alias("promotion_name"),
        "sku", ((k % 4 + 1) * 0.05).alias("discount_rate"))


_PROMO_SQL = """
, pc AS (SELECT sku, CAST(DATE '1995-06-01' + CAST((CAST(regexp_extract(sku, '([0-9]+)', 1) AS INT) * 13 + (k % 8) * 173) % 2000
                                                   + CASE WHEN k >= 8 THEN 2 ELSE 0 END AS INT) AS DATE) AS promo_date,
                concat('PROMO_', CAST(k AS VARCHAR)) AS promotion_name, (k % 4 + 1) * 0.05 AS discount_rate
         FROM (SELECT DISTINCT p_brand AS sku FROM part WHERE p_brand IS NOT NULL) b, (SELECT unnest(range(16)) AS k) n),
d AS (SELECT sku, CAST(timestamp AS DATE) AS date, sum(quantity_sold) AS units FROM fx_pos
      WHERE sku IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2)
"""


@query("p09_promotion_effects", osql("fx_pos", _PROMO_SQL + f"""
SELECT pc.sku, promotion_name, promo_date, round(CAST(discount_rate AS DOUBLE), 6) AS discount_rate,
       round(avg(units) FILTER (WHERE date < promo_date), 6) AS before_avg_units, max(units) FILTER (WHERE date = promo_date) AS during_units,
       round(avg(units) FILTER (WHERE date > promo_date), 6) AS after_avg_units, count(units) AS days_with_sales,
       (SELECT count(*) FROM pc o WHERE o.sku = pc.sku AND o.promotion_name <> pc.promotion_name
         AND o.promo_date BETWEEN pc.promo_date - INTERVAL {NEAR} DAY AND pc.promo_date + INTERVAL {NEAR} DAY) AS others_near
FROM pc LEFT JOIN d ON d.sku = pc.sku AND d.date BETWEEN promo_date - INTERVAL {NEAR} DAY AND promo_date + INTERVAL {NEAR} DAY
GROUP BY pc.sku, promotion_name, promo_date, discount_rate"""))
def p09_promotion_effects(spark, sf_dir):
    """Units a day before, on and after each promotion of a SKU. The interval join goes by day: each
    promotion is dealt to the days around it and meets the daily sums by (sku, date), an equality
    join of fixed fan-out. Promotions that overlap stay apart, and are counted."""
    daily = report(pos_prepared(spark, sf_dir), ["sku", "date"], [F.sum("quantity_sold").alias("units")])
    promos = promotion_calendar(spark, sf_dir)
    around = promos.withColumn("date", F.explode(F.sequence(F.date_sub("promo_date", NEAR), F.date_add("promo_date", NEAR))))
    id_ = ["sku", "promotion_name", "promo_date", "discount_rate"]
    same_day = promos.groupBy("sku", c("promo_date").alias("date")).agg(F.count(F.lit(1)).alias("starting"))
    j = around.join(daily, ["sku", "date"], "left").join(same_day, ["sku", "date"], "left")
    p = c("promo_date")
    return j.groupBy(*id_).agg(
        S.rnd(F.avg(F.when(c("date") < p, c("units")))).alias("before_avg_units"), F.max(F.when(c("date") == p, c("units"))).alias("during_units"),
        S.rnd(F.avg(F.when(c("date") > p, c("units")))).alias("after_avg_units"), F.count("units").alias("days_with_sales"),
        (F.sum(F.coalesce("starting", F.lit(0))) - 1).alias("others_near")).withColumn("discount_rate", S.rnd("discount_rate"))


FEATURES, FOLDS, HORIZON = ["lag1", "lag7", "weekend"], 3, 28


def _rows(spark, sf_dir):
    daily = O.daily_series(pos_prepared(spark, sf_dir), "sku", "date", "quantity_sold").withColumnRenamed("quantity_sold", "units")
    return O.with_fold(O.lag_features(daily, "sku", "date", "units"), "date", FOLDS, HORIZON)


def _equations(rows):
    return O.equations_by_fold(O.equation_blocks(rows, "sku", "units", FEATURES), "sku", FOLDS)


def _coefficients(rows):
    return O.solve(_equations(rows), ["sku", "fold"], "units", FEATURES)


_NAMES = [*FEATURES, "units"]
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i:]]
_C = {(a, b): f"(s_{a}_{b} / n - s_{a} / n * (s_{b} / n))" for a, b in _PAIRS}
_C |= {(b, a): v for (a, b), v in _C.items()}


def _det(columns: list[str]) -> str:
    """Determinant of the features' covariances with one column, or none, taken by the target."""
    m = [[_C[(r, x)] for x in columns] for r in FEATURES]
    return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
            f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")


_FORECAST_SQL = f"""
, s AS (SELECT sku, CAST(timestamp AS DATE) AS date, sum(quantity_sold) AS units FROM fx_pos
        WHERE sku IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2),
days AS (SELECT sku, CAST(unnest(generate_series((SELECT min(date) FROM s), (SELECT max(date) FROM s), INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT sku FROM s) k),
daily AS (SELECT days.sku, days.date, CAST(coalesce(units, 0) AS DOUBLE) AS units FROM days LEFT JOIN s ON s.sku = days.sku AND s.date = days.date),
l AS (SELECT *, lag(units, 1) OVER w AS lag1, lag(units, 7) OVER w AS lag7, CAST(isodow(date) >= 6 AS DOUBLE) AS weekend
      FROM daily WINDOW w AS (PARTITION BY sku ORDER BY date)),
r AS (SELECT *, CAST(greatest(0, {FOLDS} - floor(date_diff('day', date, (SELECT max(date) FROM s)) / {HORIZON})) AS INT) AS part FROM l WHERE lag7 IS NOT NULL),
e AS (SELECT sku, CAST(fold AS INT) AS fold, count(*) AS n, {", ".join(f"sum({a}) AS s_{a}" for a in _NAMES)}, {", ".join(f"sum({a} * {b}) AS s_{a}_{b}" for a, b in _PAIRS)}
      FROM r, (SELECT unnest(range(1, {FOLDS + 1})) AS fold) f WHERE part < fold GROUP BY 1, 2),
g AS (SELECT *, {_det(FEATURES)} AS det, {" * ".join(_C[(f, f)] for f in FEATURES)} AS scale FROM e),
b AS (SELECT *, {", ".join(f"CASE WHEN det > 1e-9 * scale THEN {_det([('units' if x == f else x) for x in FEATURES])} / det END AS b_{f}" for f in FEATURES)} FROM g),
k AS (SELECT *, s_units / n - {" - ".join(f"b_{f} * (s_{f} / n)" for f in FEATURES)} AS intercept FROM b)
"""


@query("p13_forecast_equations", osql("fx_pos", _FORECAST_SQL + f"""
SELECT sku, fold, n, {", ".join(f"s_{a}" for a in _NAMES)}, {", ".join(f"s_{a}_{b}" for a, b in _PAIRS)} FROM e"""))
def p13_forecast_equations(spark, sf_dir):
    """The sums of products of each SKU up to each origin."""
    return _equations(_rows(spark, sf_dir))


@query("p13_forecast_coefficients", osql("fx_pos", _FORECAST_SQL + f"""
SELECT sku, fold, n, round(intercept, 6) AS intercept, {", ".join(f"round(b_{f}, 6) AS b_{f}" for f in FEATURES)} FROM k"""))
def p13_forecast_coefficients(spark, sf_dir):
    out = _coefficients(_rows(spark, sf_dir))
    return out.select("sku", "fold", "n", *[S.rnd(x).alias(x) for x in ("intercept", *[f"b_{f}" for f in FEATURES])])


@query("p13_forecast_errors", osql("fx_pos", _FORECAST_SQL + f"""
SELECT r.sku, fold, count(*) AS n_test, round(avg(abs(units - (intercept + {" + ".join(f"b_{f} * {f}" for f in FEATURES)}))), 6) AS mae_model,
       round(avg(abs(units - lag7)), 6) AS mae_naive
FROM r JOIN k ON k.sku = r.sku AND k.fold = r.part GROUP BY r.sku, fold"""))
def p13_forecast_errors(spark, sf_dir):
    """Rolling origin: the days behind each origin, by the model and by the value a week before."""
    rows = _rows(spark, sf_dir)
    out = O.rolling_origin_errors(rows, _coefficients(rows), "sku", "units", FEATURES)
    return out.select("sku", "fold", "n_test", S.rnd("mae_model").alias("mae_model"), S.rnd("mae_naive").alias("mae_naive"))
