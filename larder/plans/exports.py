"""Reports, samples, versions and stored scores (S08-S12, S14, S15, M11) and bounded chart frames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators import explore as X
from larder.operators.fingerprint import column_totals
from larder.operators.frames import scatter_frame
from larder.operators.iforest import feature_columns
from larder.operators.modelstore import cached_forest, store_scores
from larder.operators.report import report, unpivot_metrics
from larder.operators.sampling import sample, stratified_sample
from larder.plans.b2b import _bsql, b2b_prepared
from larder.plans.dispatch import DELAY, _dsql, dispatch_prepared
from larder.plans.explore import _RANGE, FIRST, LAST
from larder.plans.models import NON_FEATURES, materialised_features
from larder.plans.oracle_views import osql
from larder.plans.registry import ORACLE, QUERIES, query
from larder.plans.routes import ROUTES_SQL, routes_prepared
from larder.session import ship_package
from larder.sources.clean import drop_suffixed_duplicates
from larder.sources.fixtures import fx_dispatch, fx_returns, fx_sensors, fx_waste
from larder.sources.publish import export_csv, publish_csv, publish_json, read_report
from larder.sources.versions import VersionedTable
from larder.streaming.streams import run_folder

c = F.col


# --- Reports as files -------------------------------------------------------------------------
@query("s08_csv_report", ORACLE["r13_pos_by_region"])
def s08_csv_report(spark, sf_dir):
    """The regional sales report as one CSV file, read back."""
    df = QUERIES["r13_pos_by_region"](spark, sf_dir)
    path = publish_csv(df, os.path.join(run_folder(spark, "s08"), "pos_by_region.csv"), order=["region"])
    return read_report(spark, path, df.schema)


def _long_sql(section: str, name: str) -> str:
    return (f"SELECT '{section}' AS section, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({ORACLE[name]}) o) ON COLUMNS(*) INTO NAME metric VALUE value)")


_SECTIONS = {"sensors": "r90_sensors_overview", "production": "r59_prod_overview"}


@query("s09_metrics_table", " UNION ALL ".join(_long_sql(x, n) for x, n in _SECTIONS.items()))
def s09_metrics_table(spark, sf_dir):
    """Overviews as one written table of (section, metric, value)."""
    out = None
    for section, name in _SECTIONS.items():
        rows = unpivot_metrics(QUERIES[name](spark, sf_dir), section).where("value is not null")
        out = rows if out is None else out.unionByName(rows)
    table = VersionedTable(spark, run_folder(spark, "s09"))
    table.write(out.coalesce(1))
    return table.read()


@query("s10_json_report", ORACLE["m02_zscore_folds"])
def s10_json_report(spark, sf_dir):
    """The metrics of each fold as JSON lines, read back."""
    df = QUERIES["m02_zscore_folds"](spark, sf_dir)
    path = publish_json(df, os.path.join(run_folder(spark, "s10"), "folds.json"), order=["fold"])
    return read_report(spark, path, df.schema, "json")


@query("s12_filtered_export", ORACLE["f07_dispatch_selection"])
def s12_filtered_export(spark, sf_dir):
    """The selected dispatches as a folder of CSV files, read back."""
    df = QUERIES["f07_dispatch_selection"](spark, sf_dir)
    return read_report(spark, export_csv(df, run_folder(spark, "s12")), df.schema)


# --- Samples ----------------------------------------------------------------------------------
_SAMPLED = ["dispatch_id", "timestamp", "plant_id", "route_id", "sku", DELAY]


@query("s11_dispatch_sample", _dsql(f"""
SELECT {", ".join(_SAMPLED)} FROM d ORDER BY md5(concat('42|', CAST(dispatch_id AS VARCHAR))), dispatch_id LIMIT 1000"""))
def s11_dispatch_sample(spark, sf_dir):
    return sample(dispatch_prepared(spark, sf_dir).select(*_SAMPLED), ["dispatch_id"], 1000)


@query("s11_dispatch_sample_by_route", _dsql(f"""
SELECT {", ".join(_SAMPLED)} FROM d
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY md5(concat('42|', CAST(dispatch_id AS VARCHAR))), dispatch_id) <= 20"""))
def s11_dispatch_sample_by_route(spark, sf_dir):
    """Twenty dispatches of each route, and of those without one."""
    return stratified_sample(dispatch_prepared(spark, sf_dir).select(*_SAMPLED), "route_id", ["dispatch_id"], 20)


# --- Fingerprints and versions ----------------------------------------------------------------
_COLUMNS = {"dispatch_id": True, "timestamp": False, "plant_id": False, "route_id": False, "vehicle_id": False, "retailer_id": False, "sku": False,
            "qty_dispatched": True, "expected_arrival": False, "actual_arrival": False}


@query("s14_dispatch_totals", osql("fx_dispatch", " UNION ALL ".join(
    f"SELECT '{x}' AS column_name, count(*) AS n_rows, count(*) - count({x}) AS n_nulls, {f'round(CAST(sum({x}) AS DOUBLE), 2)' if n else 'CAST(NULL AS DOUBLE)'} AS total FROM fx_dispatch"
    for x, n in _COLUMNS.items())))
def s14_dispatch_totals(spark, sf_dir):
    """Rows, nulls and total of each column, which the fingerprint of a saved model stands for."""
    return column_totals(fx_dispatch(spark, sf_dir))


_VERSIONS_SQL = """
, t AS (SELECT count(*) AS n, CAST(sum(qty_returned) AS BIGINT) AS units FROM fx_returns)
SELECT CAST(v AS INT) AS version, CAST(k AS INT) AS n_columns, n AS n_rows, units, o AS origin
FROM t, (VALUES (1, 11, 'write'), (2, 9, 'write'), (3, 11, 'rollback to 1')) x(v, k, o)"""


@query("s15_rewrite_and_rollback", osql("fx_returns", _VERSIONS_SQL))
def s15_rewrite_and_rollback(spark, sf_dir):
    """A table with repeated columns, rewritten from itself without them, then rolled back; every version read again."""
    r = fx_returns(spark, sf_dir)
    table = VersionedTable(spark, run_folder(spark, "s15"))
    table.write(r.withColumns({"sku_1": c("sku"), "reason_code_1": c("reason_code")}))
    table.write(drop_suffixed_duplicates(table.read()))
    table.rollback(1)
    out = None
    for v in table.versions():
        rows = table.read(v)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), S.sum0("qty_returned").cast("bigint").alias("units")).select(
            F.lit(v).alias("version"), F.lit(len(rows.columns)).alias("n_columns"), "n_rows", "units", F.lit(table.manifest(v)["origin"]).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out


# --- Stored scores ----------------------------------------------------------------------------
def _stored_scores(spark, sf_dir) -> DataFrame:
    """Fit and save a forest, find it again by its content, score a range of days with it and store the
    scores by day; the days stored."""
    ship_package(spark)
    folder = run_folder(spark, "m11")
    feats = materialised_features(spark, sf_dir)
    cols = feature_columns(feats, NON_FEATURES)
    cached_forest(feats, cols, ["dispatch_id"], os.path.join(folder, "models"), n_trees=50)
    forest, known = cached_forest(feats.orderBy(F.xxhash64("dispatch_id")), cols, ["dispatch_id"], os.path.join(folder, "models"), n_trees=50)
    if not known:
        raise RuntimeError("the saved model was not found again")
    part = X.date_range(feats, "timestamp", FIRST, LAST)
    scores = forest.score(part, list(dict.fromkeys(["dispatch_id", "timestamp", "route_id", DELAY, *cols])))
    return store_scores(scores.select("dispatch_id", "timestamp", "route_id", DELAY, "if_score", "if_anomaly", F.to_date("timestamp").alias("day")),
                        os.path.join(folder, "scores"), "day")


@query("m11_score_and_store")
def m11_score_and_store(spark, sf_dir):
    """The 200 highest scores of the stored days."""
    return _stored_scores(spark, sf_dir).orderBy(c("if_score").desc(), "dispatch_id").limit(200)


@query("m11_stored_days", _dsql(f"""
SELECT CAST(timestamp AS DATE) AS day, count(*) AS dispatches, count(DISTINCT route_id) AS routes, round(avg(dispatch_delay_minutes), 6) AS mean_delay,
       CAST(count(*) AS BIGINT) AS scored
FROM d WHERE {_RANGE} GROUP BY 1"""))
def m11_stored_days(spark, sf_dir):
    s = _stored_scores(spark, sf_dir)
    return s.groupBy("day").agg(F.count(F.lit(1)).alias("dispatches"), F.countDistinct("route_id").alias("routes"), S.rnd(F.avg(DELAY)).alias("mean_delay"),
                                F.count("if_score").alias("scored"))


# --- Chart frames -----------------------------------------------------------------------------
def _grid_sql(x: str, y: str, bins: int, by: str | None = None) -> str:
    k = f"{by}, " if by else ""
    where = f"{x} IS NOT NULL AND {y} IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")

    def cell(v):
        return f"CASE WHEN {v}1 = {v}0 THEN 0 ELSE CAST(least(floor((gr.{v} - {v}0) / (({v}1 - {v}0) / {bins}.0::DOUBLE)), {bins - 1}) AS INT) END"

    return osql("fx_routes", ROUTES_SQL + f"""
, gr AS (SELECT {k}CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM rt WHERE {where}),
sp AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM gr)
SELECT {k}{cell("x")} AS cell_x, {cell("y")} AS cell_y, count(*) AS points, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y,
       round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y
FROM gr, sp GROUP BY {k}cell_x, cell_y""")


@query("v06_distance_stops_grid", _grid_sql("distance_km", "stops_count", 40, "route_type"))
def v06_distance_stops_grid(spark, sf_dir):
    return scatter_frame(routes_prepared(spark, sf_dir), "distance_km", "stops_count", 40, "route_type")


@query("v06_stops_strain_grid", _grid_sql("stops_count", "capacity_strain", 40))
def v06_stops_strain_grid(spark, sf_dir):
    return scatter_frame(routes_prepared(spark, sf_dir), "stops_count", "capacity_strain", 40)


@query("v06_complexity_risk_grid", _grid_sql("complexity_score", "risk_score", 40))
def v06_complexity_risk_grid(spark, sf_dir):
    return scatter_frame(routes_prepared(spark, sf_dir), "complexity_score", "risk_score", 40)


@query("v06_riskiest_routes", osql("fx_routes", ROUTES_SQL + """
SELECT route_name, round(complexity_score, 6) AS complexity_score, round(risk_score, 6) AS risk_score
FROM rt WHERE risk_score IS NOT NULL ORDER BY risk_score DESC, route_name LIMIT 3"""))
def v06_riskiest_routes(spark, sf_dir):
    """The three points that the chart names."""
    r = routes_prepared(spark, sf_dir).where(c("risk_score").isNotNull()).orderBy(c("risk_score").desc(), "route_name").limit(3)
    return r.select("route_name", S.rnd("complexity_score").alias("complexity_score"), S.rnd("risk_score").alias("risk_score"))


@query("v05_price_by_sku", _bsql("""
SELECT sku, round(avg(price_per_unit), 6) AS mean_price, round(stddev_samp(price_per_unit), 6) AS std_price,
       round(avg(price_per_unit) - stddev_samp(price_per_unit), 6) AS low, round(avg(price_per_unit) + stddev_samp(price_per_unit), 6) AS high
FROM b GROUP BY sku"""))
def v05_price_by_sku(spark, sf_dir):
    p = "price_per_unit"
    g = report(b2b_prepared(spark, sf_dir), "sku", [F.avg(p).alias("m"), F.stddev_samp(p).alias("s")])
    return g.select("sku", S.rnd("m").alias("mean_price"), S.rnd("s").alias("std_price"), S.rnd(c("m") - c("s")).alias("low"), S.rnd(c("m") + c("s")).alias("high"))


@query("v07_waste_reason_pie", osql("fx_waste", """
, g AS (SELECT waste_reason_code AS reason, count(*) AS incidents, CAST(sum(qty_waste) AS BIGINT) AS units FROM fx_waste WHERE waste_reason_code IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY incidents DESC, reason) AS place FROM g),
o AS (SELECT CASE WHEN place <= 6 THEN reason ELSE 'Other' END AS reason, CAST(sum(incidents) AS BIGINT) AS incidents, CAST(sum(units) AS BIGINT) AS units FROM r GROUP BY 1)
SELECT *, round(incidents * 100.0 / (SELECT sum(incidents) FROM g), 6) AS share_pct FROM o"""))
def v07_waste_reason_pie(spark, sf_dir):
    """The six most frequent reasons and the others together; ranked by a top-k of the grouped rows."""
    w = fx_waste(spark, sf_dir).withColumnRenamed("waste_reason_code", "reason")
    g = report(w, "reason", [F.count(F.lit(1)).alias("incidents"), S.sum0("qty_waste").cast("bigint").alias("units")])
    top = g.orderBy(c("incidents").desc(), "reason").limit(6).select(c("reason").alias("named"))
    total = g.agg(F.sum("incidents").alias("all"))
    o = (g.join(F.broadcast(top), c("reason") == c("named"), "left").groupBy(F.coalesce("named", F.lit("Other")).alias("reason"))
         .agg(F.sum("incidents").alias("incidents"), F.sum("units").alias("units")))
    return o.crossJoin(F.broadcast(total)).select("reason", "incidents", "units", S.rnd(S.pct("incidents", "all")).alias("share_pct"))


_TOP9 = "top9 AS (SELECT route_id FROM d WHERE route_id IS NOT NULL GROUP BY route_id ORDER BY count(*) DESC, route_id LIMIT 9)"


def _top_routes(d: DataFrame, n: int = 9) -> DataFrame:
    top = report(d, "route_id", [F.count(F.lit(1)).alias("k")], order=[c("k").desc()], limit=n)
    return d.join(F.broadcast(top.select("route_id")), "route_id", "left_semi")


@query("v09_route_multiples", _dsql(f"""
, {_TOP9}
SELECT route_id, dispatch_id, timestamp, dispatch_delay_minutes FROM d WHERE route_id IN (SELECT route_id FROM top9) AND timestamp IS NOT NULL"""))
def v09_route_multiples(spark, sf_dir):
    """The dispatches of the nine busiest routes, by route and time."""
    d = _top_routes(dispatch_prepared(spark, sf_dir)).where(c("timestamp").isNotNull())
    return d.select("route_id", "dispatch_id", "timestamp", DELAY).orderBy("route_id", "timestamp", "dispatch_id")


@query("v09_route_daily_mean", _dsql(f"""
, {_TOP9},
g AS (SELECT route_id, CAST(timestamp AS DATE) AS date, sum(dispatch_delay_minutes) AS s, count(dispatch_delay_minutes) AS n
      FROM d WHERE route_id IN (SELECT route_id FROM top9) AND timestamp IS NOT NULL GROUP BY 1, 2)
SELECT route_id, date, n AS trips, round(s / nullif(n, 0), 6) AS mean_delay, round(sum(s) OVER w / nullif(sum(n) OVER w, 0), 6) AS rolling_mean
FROM g WINDOW w AS (PARTITION BY route_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"""))
def v09_route_daily_mean(spark, sf_dir):
    """Each of the nine routes by day with the mean of the last seven days; a window holds a route's days."""
    d = _top_routes(dispatch_prepared(spark, sf_dir)).where(c("timestamp").isNotNull())
    g = d.groupBy("route_id", F.to_date("timestamp").alias("date")).agg(F.sum(DELAY).alias("s"), F.count(DELAY).alias("n"))
    w = Window.partitionBy("route_id").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-6, 0)
    return g.select("route_id", "date", c("n").alias("trips"), S.rnd(S.ratio("s", "n")).alias("mean_delay"),
                    S.rnd(S.ratio(F.sum("s").over(w), F.sum("n").over(w))).alias("rolling_mean"))


@query("v10_top_equipment", osql("fx_sensors", """
SELECT equipment_id, count(*) AS readings, round(avg(metric_value), 6) AS mean_value FROM fx_sensors
WHERE equipment_id IS NOT NULL GROUP BY equipment_id ORDER BY readings DESC, equipment_id LIMIT 15"""))
def v10_top_equipment(spark, sf_dir):
    return report(fx_sensors(spark, sf_dir), "equipment_id", [F.count(F.lit(1)).alias("readings"), S.rnd(F.avg("metric_value")).alias("mean_value")],
                  order=[c("readings").desc()], limit=15)
