"""Route and vehicle configuration reports: C13, C29-C33, A16, A35, F02, F03, R80-R86, T04."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.report import report
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_routes

c = F.col


def routes_prepared(spark, sf_dir) -> DataFrame:
    df = fx_routes(spark, sf_dir)
    stops = D.stop_count("stops_list")
    minutes = F.greatest(F.coalesce(c("estimated_time_min"), F.lit(0)), F.lit(1))   # C13
    strain = S.ratio(stops * 50, "load_capacity_kg")
    return df.withColumns({
        "stops_count": stops,
        "estimated_time_minutes": minutes,
        "efficiency_km_per_min": S.ratio("distance_km", minutes),
        "stops_density": S.ratio(stops, "distance_km"),
        "avg_distance_per_stop": S.ratio("distance_km", stops),
        "complexity_score": S.ratio(stops * c("distance_km"), minutes),
        "route_type": D.route_type("distance_km"),
        "capacity_category": D.capacity_category("load_capacity_kg"),
        "start_time_category": D.start_window_category("trip_start_window"),
        "load_utilization": stops * 50,
        "capacity_strain": strain,
        "risk_score": c("distance_km") / 100 * 0.3 + stops / 20.0 * 0.3 + strain * 0.4,   # C33
    })


ROUTES_SQL = """WITH r0 AS (
  SELECT *, CASE WHEN stops_list IS NULL THEN 0 ELSE len(string_split(stops_list, ',')) END AS stops_count,
         greatest(coalesce(estimated_time_min, 0), 1) AS estimated_time_minutes
  FROM fx_routes),
rt AS (
  SELECT *, distance_km / estimated_time_minutes AS efficiency_km_per_min,
         stops_count / nullif(distance_km, 0) AS stops_density,
         stops_count * distance_km / estimated_time_minutes AS complexity_score,
         CASE WHEN distance_km > 0 AND distance_km <= 30 THEN 'Urban' WHEN distance_km > 30 AND distance_km <= 60 THEN 'Suburban'
              WHEN distance_km > 60 AND distance_km <= 150 THEN 'Rural' END AS route_type,
         stops_count * 50 / nullif(CAST(load_capacity_kg AS DOUBLE), 0) AS capacity_strain,
         distance_km / 100 * 0.3 + stops_count / 20.0 * 0.3 + (stops_count * 50 / nullif(CAST(load_capacity_kg AS DOUBLE), 0)) * 0.4 AS risk_score
  FROM r0)
"""


def _rsql(body):
    return osql("fx_routes", ROUTES_SQL + body)


@query("r80_routes_by_route", _rsql("""
SELECT route_id, arg_min(route_name, route_name) AS route_name, arg_min(distance_km, route_name) AS distance_km,
       round(avg(estimated_time_minutes), 6) AS avg_estimated_time_min, arg_min(stops_count, route_name) AS stops_count,
       arg_min(region, route_name) AS region, round(avg(load_capacity_kg), 6) AS avg_load_capacity_kg,
       round(avg(efficiency_km_per_min), 6) AS avg_efficiency_km_per_min, round(avg(risk_score), 6) AS avg_risk_score,
       count(DISTINCT vehicle_id) AS num_vehicles, count(DISTINCT driver_id) AS num_drivers
FROM rt WHERE route_id IS NOT NULL GROUP BY route_id"""))
def r80_routes_by_route(spark, sf_dir):
    # "first" = row order of the configuration table, i.e. the smallest route name.
    return report(routes_prepared(spark, sf_dir), "route_id", [
        S.first_nonnull("route_name", "route_name").alias("route_name"),
        S.first_nonnull("distance_km", "route_name").alias("distance_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("avg_estimated_time_min"),
        S.first_nonnull("stops_count", "route_name").alias("stops_count"),
        S.first_nonnull("region", "route_name").alias("region"),
        S.rnd(F.avg("load_capacity_kg")).alias("avg_load_capacity_kg"),
        S.rnd(F.avg("efficiency_km_per_min")).alias("avg_efficiency_km_per_min"),
        S.rnd(F.avg("risk_score")).alias("avg_risk_score"),
        S.nunique("vehicle_id").alias("num_vehicles"), S.nunique("driver_id").alias("num_drivers"),
    ], order=[c("avg_risk_score").desc()])


@query("r81_routes_by_region", _rsql("""
SELECT region, count(DISTINCT route_id) AS num_routes, round(avg(distance_km), 6) AS avg_distance_km,
       round(sum(distance_km), 6) AS total_distance_km, round(avg(estimated_time_minutes), 6) AS avg_time_min,
       round(avg(stops_count), 6) AS avg_stops, CAST(sum(stops_count) AS BIGINT) AS total_stops,
       round(avg(load_capacity_kg), 6) AS avg_capacity_kg, round(avg(risk_score), 6) AS avg_risk_score
FROM rt WHERE region IS NOT NULL GROUP BY region"""))
def r81_routes_by_region(spark, sf_dir):
    return report(routes_prepared(spark, sf_dir), "region", [
        S.nunique("route_id").alias("num_routes"), S.rnd(F.avg("distance_km")).alias("avg_distance_km"),
        S.rnd(F.sum("distance_km")).alias("total_distance_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("avg_time_min"),
        S.rnd(F.avg("stops_count")).alias("avg_stops"), S.sum0("stops_count").cast("bigint").alias("total_stops"),
        S.rnd(F.avg("load_capacity_kg")).alias("avg_capacity_kg"), S.rnd(F.avg("risk_score")).alias("avg_risk_score"),
    ], order=[c("num_routes").desc()])


def _mode_sql(key, where=""):
    return f"""
, m AS (SELECT {key}, region, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, region) AS rk
        FROM rt WHERE {key} IS NOT NULL AND region IS NOT NULL{where} GROUP BY {key}, region)"""


@query("r82_routes_by_vehicle", _rsql(_mode_sql("vehicle_id") + """
SELECT rt.vehicle_id, count(DISTINCT route_id) AS num_routes, round(avg(distance_km), 6) AS avg_distance_km,
       round(avg(estimated_time_minutes), 6) AS avg_time_min, round(avg(stops_count), 6) AS avg_stops,
       arg_min(load_capacity_kg, route_name) AS capacity_kg, round(avg(risk_score), 6) AS avg_risk_score,
       any_value(m.region) AS primary_region
FROM rt LEFT JOIN m ON m.vehicle_id = rt.vehicle_id AND m.rk = 1 WHERE rt.vehicle_id IS NOT NULL GROUP BY rt.vehicle_id"""))
def r82_routes_by_vehicle(spark, sf_dir):
    return report(routes_prepared(spark, sf_dir), "vehicle_id", [
        S.nunique("route_id").alias("num_routes"), S.rnd(F.avg("distance_km")).alias("avg_distance_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("avg_time_min"), S.rnd(F.avg("stops_count")).alias("avg_stops"),
        S.first_nonnull("load_capacity_kg", "route_name").alias("capacity_kg"),
        S.rnd(F.avg("risk_score")).alias("avg_risk_score"),
        S.mode_det("region").alias("primary_region"),   # A16: smallest region on a tie
    ], order=[c("num_routes").desc()])


@query("r83_routes_by_driver", _rsql(_mode_sql("driver_id") + """
SELECT rt.driver_id, count(DISTINCT route_id) AS num_routes, round(avg(distance_km), 6) AS avg_distance_km,
       round(avg(estimated_time_minutes), 6) AS avg_time_min, round(avg(stops_count), 6) AS avg_stops,
       round(avg(risk_score), 6) AS avg_risk_score, any_value(m.region) AS primary_region
FROM rt LEFT JOIN m ON m.driver_id = rt.driver_id AND m.rk = 1 WHERE rt.driver_id IS NOT NULL GROUP BY rt.driver_id"""))
def r83_routes_by_driver(spark, sf_dir):
    return report(routes_prepared(spark, sf_dir), "driver_id", [
        S.nunique("route_id").alias("num_routes"), S.rnd(F.avg("distance_km")).alias("avg_distance_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("avg_time_min"), S.rnd(F.avg("stops_count")).alias("avg_stops"),
        S.rnd(F.avg("risk_score")).alias("avg_risk_score"), S.mode_det("region").alias("primary_region"),
    ], order=[c("num_routes").desc()])


@query("r84_routes_by_type", _rsql("""
, dim AS (SELECT * FROM (VALUES (1, 'Urban'), (2, 'Suburban'), (3, 'Rural')) t(type_no, route_type)),
g AS (SELECT route_type, count(route_id) AS num_configs, round(avg(distance_km), 6) AS avg_distance_km,
             min(distance_km) AS min_distance_km, max(distance_km) AS max_distance_km,
             round(avg(estimated_time_minutes), 6) AS avg_time_min, round(avg(stops_count), 6) AS avg_stops,
             round(avg(efficiency_km_per_min), 6) AS avg_efficiency, round(avg(risk_score), 6) AS avg_risk_score
      FROM rt WHERE route_type IS NOT NULL GROUP BY route_type)
SELECT CAST(type_no AS INT) AS type_no, dim.route_type, CAST(coalesce(num_configs, 0) AS BIGINT) AS num_configs,
       avg_distance_km, min_distance_km, max_distance_km, avg_time_min, avg_stops, avg_efficiency, avg_risk_score
FROM dim LEFT JOIN g ON g.route_type = dim.route_type"""))
def r84_routes_by_type(spark, sf_dir):
    g = report(routes_prepared(spark, sf_dir), "route_type", [
        F.count("route_id").alias("num_configs"), S.rnd(F.avg("distance_km")).alias("avg_distance_km"),
        F.min("distance_km").alias("min_distance_km"), F.max("distance_km").alias("max_distance_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("avg_time_min"), S.rnd(F.avg("stops_count")).alias("avg_stops"),
        S.rnd(F.avg("efficiency_km_per_min")).alias("avg_efficiency"), S.rnd(F.avg("risk_score")).alias("avg_risk_score"),
    ])
    # Categorical grouping lists empty categories too: left join from a 3-row dimension.
    dim = F.broadcast(spark.createDataFrame([(i + 1, t) for i, t in enumerate(D.ROUTE_TYPES)],
                                            "type_no int, route_type string"))
    out = dim.join(g, "route_type", "left")
    return out.select("type_no", "route_type", F.coalesce(c("num_configs"), F.lit(0)).cast("bigint").alias("num_configs"),
                      "avg_distance_km", "min_distance_km", "max_distance_km", "avg_time_min", "avg_stops",
                      "avg_efficiency", "avg_risk_score")


@query("r85_routes_high_risk_top50", _rsql("""
SELECT route_id, vehicle_id, route_name, route_type, distance_km, stops_count, load_capacity_kg,
       round(capacity_strain, 6) AS capacity_strain, round(risk_score, 6) AS risk_score
FROM rt ORDER BY risk_score DESC, route_name, vehicle_id LIMIT 50"""))
def r85_routes_high_risk_top50(spark, sf_dir):
    df = routes_prepared(spark, sf_dir)
    # T04 nlargest: ordered limit planned as TakeOrderedAndProject.
    return (df.orderBy(c("risk_score").desc(), "route_name", "vehicle_id").limit(50)
              .select("route_id", "vehicle_id", "route_name", "route_type", "distance_km", "stops_count",
                      "load_capacity_kg", S.rnd("capacity_strain").alias("capacity_strain"),
                      S.rnd("risk_score").alias("risk_score")))


@query("r86_routes_overview", _rsql("""
SELECT count(*) AS configurations, count(DISTINCT route_id) AS routes, count(DISTINCT vehicle_id) AS vehicles,
       count(DISTINCT driver_id) AS drivers, round(avg(distance_km), 6) AS mean_km,
       round(avg(estimated_time_minutes), 6) AS mean_minutes, round(avg(stops_count), 6) AS mean_stops,
       count(*) FILTER (WHERE capacity_strain > 1) AS over_capacity, count(*) FILTER (WHERE capacity_strain < 0.5) AS under_used,
       count(*) FILTER (WHERE stops_density > 0.5) AS dense_routes, count(*) FILTER (WHERE stops_density < 0.2) AS sparse_routes,
       count(*) FILTER (WHERE risk_score > 0.7) AS high_risk, count(*) FILTER (WHERE risk_score < 0.3) AS low_risk,
       count(*) FILTER (WHERE complexity_score > 10) AS complex_routes,
       count(*) FILTER (WHERE route_type = 'Rural' AND estimated_time_minutes > 180) AS long_rural,
       count(*) FILTER (WHERE route_type = 'Urban' AND stops_density > 0.5) AS dense_urban,
       round(count(*) * 1.0 / count(DISTINCT vehicle_id), 6) AS configs_per_vehicle
FROM rt"""))
def r86_routes_overview(spark, sf_dir):
    df = routes_prepared(spark, sf_dir)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("configurations"), S.nunique("route_id").alias("routes"), S.nunique("vehicle_id").alias("vehicles"),
        S.nunique("driver_id").alias("drivers"), S.rnd(F.avg("distance_km")).alias("mean_km"),
        S.rnd(F.avg("estimated_time_minutes")).alias("mean_minutes"), S.rnd(F.avg("stops_count")).alias("mean_stops"),
        F.count_if(c("capacity_strain") > 1).alias("over_capacity"),
        F.count_if(c("capacity_strain") < 0.5).alias("under_used"),
        F.count_if(c("stops_density") > 0.5).alias("dense_routes"),
        F.count_if(c("stops_density") < 0.2).alias("sparse_routes"),
        F.count_if(c("risk_score") > 0.7).alias("high_risk"), F.count_if(c("risk_score") < 0.3).alias("low_risk"),
        F.count_if(c("complexity_score") > 10).alias("complex_routes"),
        F.count_if((c("route_type") == "Rural") & (c("estimated_time_minutes") > 180)).alias("long_rural"),
        F.count_if((c("route_type") == "Urban") & (c("stops_density") > 0.5)).alias("dense_urban"),
        S.rnd(S.ratio(n, S.nunique("vehicle_id"))).alias("configs_per_vehicle"))


@query("a35_unique_stop_stores", osql("fx_routes", """
SELECT count(DISTINCT trim(s)) AS unique_stores, count(*) AS stop_visits
FROM (SELECT unnest(string_split(stops_list, ',')) AS s FROM fx_routes WHERE stops_list IS NOT NULL)"""))
def a35_unique_stop_stores(spark, sf_dir):
    """Distinct stores over all comma-separated stop lists (explode + countDistinct)."""
    df = fx_routes(spark, sf_dir).where(c("stops_list").isNotNull())
    stops = df.select(F.explode(F.split("stops_list", ",")).alias("s"))
    return stops.agg(F.countDistinct(F.trim("s")).alias("unique_stores"), F.count(F.lit(1)).alias("stop_visits"))


@query("c31_routes_capacity_mix", _rsql("""
, g AS (SELECT CASE WHEN load_capacity_kg > 0 AND load_capacity_kg <= 4000 THEN 'Small'
                    WHEN load_capacity_kg > 4000 AND load_capacity_kg <= 5500 THEN 'Medium'
                    WHEN load_capacity_kg > 5500 AND load_capacity_kg <= 10000 THEN 'Large' END AS capacity_category,
               CASE trip_start_window WHEN '03:00-05:00' THEN 'Early' WHEN '04:00-06:00' THEN 'Mid'
                    WHEN '05:00-07:00' THEN 'Late' END AS start_time_category, risk_score
        FROM rt)
SELECT capacity_category, start_time_category, count(*) AS configurations, round(avg(risk_score), 6) AS avg_risk_score
FROM g WHERE capacity_category IS NOT NULL AND start_time_category IS NOT NULL
GROUP BY capacity_category, start_time_category"""))
def c31_routes_capacity_mix(spark, sf_dir):
    """C31 + C32 classes with conditional risk means (V10 frame)."""
    return report(routes_prepared(spark, sf_dir), ["capacity_category", "start_time_category"],
                  [F.count(F.lit(1)).alias("configurations"), S.rnd(F.avg("risk_score")).alias("avg_risk_score")])
