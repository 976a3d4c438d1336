"""Waste and returns reports: R67-R79, A32-A34, F02, F08, F10."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.report import report, with_share
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_returns, fx_waste

c = F.col

# Case-insensitive reason patterns of preventable returns and demand mismatch: fixed values.
PREVENTABLE_PATTERN = "(?i)Expired|Damaged|Crushed|Mould"
UNSOLD_PATTERN = "(?i)Unsold"


def _qty_aggs(q, temp=None, id_col=None, extra=None):
    aggs = [S.sum0(q).alias(f"{q}_sum"), S.rnd(F.avg(q)).alias(f"{q}_mean"), F.count(q).alias(f"{q}_count")]
    if id_col:
        aggs.append(F.count(id_col).alias("records"))
    if temp:
        aggs.append(S.rnd(F.avg(temp)).alias("mean_temperature"))
    return aggs + (extra() if extra else [])


def _qty_sql(q, temp=None, id_col=None, extra=""):
    s = f"CAST(coalesce(sum({q}), 0) AS BIGINT) AS {q}_sum, round(avg({q}), 6) AS {q}_mean, count({q}) AS {q}_count"
    if id_col:
        s += f", count({id_col}) AS records"
    if temp:
        s += f", round(avg({temp}), 6) AS mean_temperature"
    return s + extra


def _register(name, view_fn, view, key, q, temp=None, id_col=None, where=None, limit=None,
              extra=None, extra_sql=""):
    """``where`` = (Column factory, SQL text); ``extra`` = factory of extra aggregates.
    Factories keep Column construction out of import time."""
    lim = f" ORDER BY {q}_sum DESC, {key} LIMIT {limit}" if limit else ""
    cond = f" AND {where[1]}" if where else ""
    sql = osql(view, f"""
SELECT {key}, {_qty_sql(q, temp, id_col, extra_sql)}
FROM {view} WHERE {key} IS NOT NULL{cond} GROUP BY {key}{lim}""")

    def fn(spark, sf_dir):
        df = view_fn(spark, sf_dir)
        if where:
            df = df.where(where[0]())
        return report(df, key, _qty_aggs(q, temp, id_col, extra), order=[c(f"{q}_sum").desc()], limit=limit)
    fn.__name__ = name
    query(name, sql)(fn)


W, TW = "qty_waste", "temperature_at_check"
_POST = (lambda: c("stage") == "post_dispatch", "stage = 'post_dispatch'")
_register("r67_waste_by_stage", fx_waste, "fx_waste", "stage", W, TW)
_register("r67_waste_by_handling", fx_waste, "fx_waste", "handling_condition", W, TW)
_register("r68_waste_by_reason", fx_waste, "fx_waste", "waste_reason_code", W)
_register("r68_waste_by_plant", fx_waste, "fx_waste", "plant_id", W)
_register("r68_waste_by_shift", fx_waste, "fx_waste", "shift", W)
_register("r69_waste_by_sku", fx_waste, "fx_waste", "sku", W, id_col="waste_id")
_register("r70_waste_by_route_top30", fx_waste, "fx_waste", "route_id", W, TW, where=_POST, limit=30)
_register("r70_waste_by_retailer_top30", fx_waste, "fx_waste", "retailer_id", W, TW, where=_POST, limit=30)
_register("r72_waste_basic_by_sku", fx_waste, "fx_waste", "sku", W)

R, TR = "qty_returned", "temperature_at_return"
_register("r73_returns_by_reason", fx_returns, "fx_returns", "reason_code", R)
_register("r73_returns_by_sku", fx_returns, "fx_returns", "sku", R)
_register("r74_returns_by_route_top30", fx_returns, "fx_returns", "route_id", R, TR, limit=30,
          extra=lambda: [S.nunique("retailer_id").alias("retailers")],
          extra_sql=", count(DISTINCT retailer_id) AS retailers")
_register("r75_returns_by_retailer_top30", fx_returns, "fx_returns", "retailer_id", R, TR, limit=30)
_register("r76_returns_by_handling", fx_returns, "fx_returns", "handling_condition", R, TR)
_register("r79_returns_basic_by_route", fx_returns, "fx_returns", "route_id", R,
          extra=lambda: [S.rnd(F.median(R)).alias(f"{R}_median")], extra_sql=f", round(median({R}), 6) AS {R}_median")


@query("r77_returns_by_date", osql("fx_returns", f"""
SELECT CAST(timestamp AS DATE) AS date, CAST(sum({R}) AS BIGINT) AS units, count(*) AS returns
FROM fx_returns WHERE timestamp IS NOT NULL GROUP BY 1"""))
def r77_returns_by_date(spark, sf_dir):
    df = fx_returns(spark, sf_dir).withColumn("date", F.to_date("timestamp"))
    return report(df, "date", [S.sum0(R).alias("units"), F.count(F.lit(1)).alias("returns")])


@query("r71_waste_overview", osql("fx_waste", f"""
SELECT count(*) AS incidents, CAST(sum({W}) AS BIGINT) AS total_units, round(avg({W}), 6) AS mean_units,
       CAST(coalesce(sum({W}) FILTER (WHERE stage = 'production'), 0) AS BIGINT) AS production_units,
       CAST(coalesce(sum({W}) FILTER (WHERE stage = 'post_dispatch'), 0) AS BIGINT) AS post_dispatch_units,
       round(coalesce(sum({W}) FILTER (WHERE stage = 'production'), 0) * 100.0 / sum({W}), 6) AS production_share_pct,
       count(*) FILTER (WHERE {TW} > 35) AS high_temp_incidents,
       CAST(coalesce(sum({W}) FILTER (WHERE {TW} > 35), 0) AS BIGINT) AS high_temp_units,
       round(count(*) FILTER (WHERE {TW} > 35) * 100.0 / count(*), 6) AS high_temp_pct,
       round(avg({TW}), 6) AS mean_temperature, min({TW}) AS min_temperature, max({TW}) AS max_temperature,
       count(*) FILTER (WHERE isodow(timestamp) >= 6) AS weekend_incidents
FROM fx_waste"""))
def r71_waste_overview(spark, sf_dir):
    df = fx_waste(spark, sf_dir)
    prod, hot = c("stage") == "production", c(TW) > 35
    prod_units = F.coalesce(F.sum(F.when(prod, c(W))), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("incidents"), S.sum0(W).alias("total_units"), S.rnd(F.avg(W)).alias("mean_units"),
        # Stage split; A33: high-temperature share (F02 threshold 35 degrees).
        prod_units.alias("production_units"),
        F.coalesce(F.sum(F.when(c("stage") == "post_dispatch", c(W))), F.lit(0)).alias("post_dispatch_units"),
        S.rnd(S.pct(prod_units, F.sum(W))).alias("production_share_pct"),
        F.count_if(hot).alias("high_temp_incidents"),
        F.coalesce(F.sum(F.when(hot, c(W))), F.lit(0)).alias("high_temp_units"),
        S.rnd(S.pct(F.count_if(hot), F.count(F.lit(1)))).alias("high_temp_pct"),
        S.rnd(F.avg(TW)).alias("mean_temperature"), F.min(TW).alias("min_temperature"),
        F.max(TW).alias("max_temperature"),
        F.count_if(S.is_weekend("timestamp")).alias("weekend_incidents"))


@query("r71_waste_high_share_skus", osql("fx_waste", f"""
SELECT sku, CAST(sum({W}) AS BIGINT) AS units, round(sum({W}) * 100.0 / (SELECT sum({W}) FROM fx_waste), 6) AS share_pct
FROM fx_waste WHERE sku IS NOT NULL GROUP BY sku
HAVING sum({W}) * 100.0 / (SELECT sum({W}) FROM fx_waste) > 10"""))
def r71_waste_high_share_skus(spark, sf_dir):
    """SKUs holding more than 10 % of all wasted units."""
    g = report(fx_waste(spark, sf_dir), "sku", [S.sum0(W).alias("units")])
    g = with_share(g, "units", "share_pct")
    return g.where(c("share_pct") > 10).withColumn("share_pct", S.rnd("share_pct"))


@query("r78_returns_overview", osql("fx_returns", f"""
SELECT count(*) AS returns, CAST(sum({R}) AS BIGINT) AS total_units, round(avg({R}), 6) AS mean_units,
       CAST(coalesce(sum({R}) FILTER (WHERE regexp_matches(reason_code, 'Expired|Damaged|Crushed|Mould', 'i')), 0) AS BIGINT) AS preventable_units,
       round(coalesce(sum({R}) FILTER (WHERE regexp_matches(reason_code, 'Expired|Damaged|Crushed|Mould', 'i')), 0) * 100.0 / sum({R}), 6) AS preventable_pct,
       CAST(coalesce(sum({R}) FILTER (WHERE regexp_matches(reason_code, 'Unsold', 'i')), 0) AS BIGINT) AS unsold_units,
       round(coalesce(sum({R}) FILTER (WHERE regexp_matches(reason_code, 'Unsold', 'i')), 0) * 100.0 / sum({R}), 6) AS unsold_pct,
       count(*) FILTER (WHERE {TR} > 35) AS high_temp_returns,
       round(avg({TR}), 6) AS mean_temperature,
       count(*) FILTER (WHERE isodow(timestamp) >= 6) AS weekend_returns
FROM fx_returns"""))
def r78_returns_overview(spark, sf_dir):
    df = fx_returns(spark, sf_dir)
    # Case-insensitive regex classes, evaluated JVM-side.
    prev, unsold = c("reason_code").rlike(PREVENTABLE_PATTERN), c("reason_code").rlike(UNSOLD_PATTERN)
    pu = F.coalesce(F.sum(F.when(prev, c(R))), F.lit(0))
    uu = F.coalesce(F.sum(F.when(unsold, c(R))), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("returns"), S.sum0(R).alias("total_units"), S.rnd(F.avg(R)).alias("mean_units"),
        pu.alias("preventable_units"), S.rnd(S.pct(pu, F.sum(R))).alias("preventable_pct"),
        uu.alias("unsold_units"), S.rnd(S.pct(uu, F.sum(R))).alias("unsold_pct"),
        F.count_if(c(TR) > 35).alias("high_temp_returns"), S.rnd(F.avg(TR)).alias("mean_temperature"),
        F.count_if(S.is_weekend("timestamp")).alias("weekend_returns"))


@query("r78_returns_route_share_top15", osql("fx_returns", f"""
SELECT route_id, CAST(sum({R}) AS BIGINT) AS units, round(avg({R}), 6) AS mean_units, count(*) AS incidents,
       count(DISTINCT retailer_id) AS retailers,
       round(sum({R}) * 100.0 / (SELECT sum({R}) FROM fx_returns), 6) AS share_pct
FROM fx_returns WHERE route_id IS NOT NULL GROUP BY route_id ORDER BY units DESC, route_id LIMIT 15"""))
def r78_returns_route_share_top15(spark, sf_dir):
    df = fx_returns(spark, sf_dir)
    g = report(df, "route_id", [S.sum0(R).alias("units"), S.rnd(F.avg(R)).alias("mean_units"),
                                F.count(F.lit(1)).alias("incidents"), S.nunique("retailer_id").alias("retailers")],
               order=[c("units").desc()], limit=15)
    # Share of all returned units, including rows whose route is missing.
    total = df.agg(F.sum(R).alias("_t"))
    return g.crossJoin(F.broadcast(total)).withColumn("share_pct", S.rnd(S.pct("units", "_t"))).drop("_t")
