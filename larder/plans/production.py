"""Production reports: R53-R59, A09, A28, A29."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.quantiles import add_quantiles
from larder.operators.report import report, with_share
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import DEFECT_COLUMNS, fx_production

c = F.col
Q = "quantity_produced"
_DEF_SUM_SQL = " + ".join(f"coalesce({d}, 0)" for d in DEFECT_COLUMNS)


def production_prepared(spark, sf_dir) -> DataFrame:
    df = fx_production(spark, sf_dir)
    total = None
    for d in DEFECT_COLUMNS:
        x = F.coalesce(c(d), F.lit(0))
        total = x if total is None else total + x
    return df.withColumns({"total_defects": total, "hour": F.hour("timestamp"),
                           "month": F.date_trunc("month", c("timestamp"))})


PROD_SQL = f"""WITH prod AS (SELECT *, {_DEF_SUM_SQL} AS total_defects, hour(timestamp) AS hour FROM fx_production)
"""


def _psql(body):
    return osql("fx_production", PROD_SQL + body)


@query("r53_prod_by_plant", _psql(f"""
SELECT plant, count({Q}) AS quantity_produced_count, CAST(sum({Q}) AS BIGINT) AS quantity_produced_sum,
       round(avg({Q}), 6) AS quantity_produced_mean, round(stddev_samp({Q}), 6) AS quantity_produced_std,
       {", ".join(f"CAST(sum({d}) AS BIGINT) AS {d}" for d in DEFECT_COLUMNS)},
       CAST(sum(total_defects) AS BIGINT) AS total_defects,
       round(sum(total_defects) * 100.0 / sum({Q}), 6) AS defect_rate_pct
FROM prod WHERE plant IS NOT NULL GROUP BY plant"""))
def r53_prod_by_plant(spark, sf_dir):
    # Defect rate = all seven defect counts over units produced (A29), per plant.
    g = report(production_prepared(spark, sf_dir), "plant", [
        F.count(Q).alias("quantity_produced_count"), S.sum0(Q).alias("quantity_produced_sum"),
        S.rnd(F.avg(Q)).alias("quantity_produced_mean"), S.rnd(F.stddev_samp(Q)).alias("quantity_produced_std"),
        *[S.sum0(d).alias(d) for d in DEFECT_COLUMNS], S.sum0("total_defects").alias("total_defects")])
    return g.withColumn("defect_rate_pct", S.rnd(S.pct("total_defects", "quantity_produced_sum")))


def _by(key, order, limit=None):
    def fn(spark, sf_dir):
        return report(production_prepared(spark, sf_dir), key, [
            F.count(Q).alias("batches"), S.sum0(Q).alias("quantity_produced_sum"),
            S.rnd(F.avg(Q)).alias("quantity_produced_mean"), S.sum0("total_defects").alias("total_defects")],
            order=[c(order).desc()], limit=limit)
    return fn


def _by_sql(key, order, limit=None):
    lim = f" ORDER BY {order} DESC, {key} LIMIT {limit}" if limit else ""
    return _psql(f"""
SELECT {key}, count({Q}) AS batches, CAST(sum({Q}) AS BIGINT) AS quantity_produced_sum,
       round(avg({Q}), 6) AS quantity_produced_mean, CAST(sum(total_defects) AS BIGINT) AS total_defects
FROM prod WHERE {key} IS NOT NULL GROUP BY {key}{lim}""")


query("r54_prod_by_line", _by_sql("line_id", "batches"))(_by("line_id", "batches"))
query("r55_prod_by_operator_top50", _by_sql("operator_id", "batches", 50))(_by("operator_id", "batches", 50))
query("r56_prod_by_sku", _by_sql("sku", "quantity_produced_sum"))(_by("sku", "quantity_produced_sum"))


@query("r57_prod_by_hour", _psql(f"""
SELECT hour, count({Q}) AS batches, round(avg({Q}), 6) AS quantity_produced_mean,
       CAST(sum({Q}) AS BIGINT) AS quantity_produced_sum FROM prod WHERE hour IS NOT NULL GROUP BY hour"""))
def r57_prod_by_hour(spark, sf_dir):
    return report(production_prepared(spark, sf_dir), "hour", [
        F.count(Q).alias("batches"), S.rnd(F.avg(Q)).alias("quantity_produced_mean"),
        S.sum0(Q).alias("quantity_produced_sum")])


@query("r58_prod_defects_summary", osql("fx_production", " UNION ALL ".join(f"""
SELECT '{d}' AS defect_type, CAST(sum({d}) AS BIGINT) AS total_count, count(*) FILTER (WHERE {d} > 0) AS batches_affected,
       round(avg({d}), 6) AS mean_per_batch, max({d}) AS max_per_batch FROM fx_production""" for d in DEFECT_COLUMNS)))
def r58_prod_defects_summary(spark, sf_dir):
    """The seven defect columns unpivoted to (defect_type, count) rows,
    then one aggregate per defect type."""
    df = fx_production(spark, sf_dir).select(*DEFECT_COLUMNS)
    long = df.unpivot([], DEFECT_COLUMNS, "defect_type", "n")
    return (long.groupBy("defect_type").agg(
        S.sum0("n").alias("total_count"), F.count_if(c("n") > 0).alias("batches_affected"),
        S.rnd(F.avg("n")).alias("mean_per_batch"), F.max("n").alias("max_per_batch"))
        .orderBy(c("total_count").desc(), "defect_type"))


@query("r59_prod_overview", _psql(f"""
SELECT count(*) AS batches, CAST(sum({Q}) AS BIGINT) AS total_units, round(avg({Q}), 6) AS mean_units,
       round(median({Q}), 6) AS median_units, min({Q}) AS min_units, max({Q}) AS max_units,
       count(*) - count(DISTINCT batch_id) AS duplicate_batch_ids,
       count(DISTINCT operator_id) AS operators, round(count(*) * 1.0 / count(DISTINCT operator_id), 6) AS batches_per_operator,
       CAST(sum(total_defects) AS BIGINT) AS total_defects,
       round(sum(total_defects) * 100.0 / sum({Q}), 6) AS defect_rate_pct,
       count(*) FILTER (WHERE timestamp IS NULL) AS missing_timestamp,
       count(*) FILTER (WHERE line_id IS NULL) AS missing_line
FROM prod"""))
def r59_prod_overview(spark, sf_dir):
    df = production_prepared(spark, sf_dir)
    n = F.count(F.lit(1))
    g = df.agg(
        n.alias("batches"), S.sum0(Q).alias("total_units"), S.rnd(F.avg(Q)).alias("mean_units"),
        F.min(Q).alias("min_units"), F.max(Q).alias("max_units"),
        # Rows whose batch id was already seen = rows - distinct ids (NULL counts as a value in pandas;
        # batch ids are never NULL here).
        (n - F.countDistinct("batch_id")).alias("duplicate_batch_ids"),
        S.nunique("operator_id").alias("operators"),
        S.rnd(S.ratio(n, S.nunique("operator_id"))).alias("batches_per_operator"),
        S.sum0("total_defects").alias("total_defects"),
        S.rnd(S.pct(F.sum("total_defects"), F.sum(Q))).alias("defect_rate_pct"),
        F.count_if(c("timestamp").isNull()).alias("missing_timestamp"),
        F.count_if(c("line_id").isNull()).alias("missing_line"))
    return add_quantiles(g, df, [], Q, {"median_units": 0.5})


@query("r59_prod_plant_share", _psql(f"""
SELECT plant, CAST(sum({Q}) AS BIGINT) AS units, round(sum({Q}) * 100.0 / sum(sum({Q})) OVER (), 6) AS share_pct
FROM prod WHERE plant IS NOT NULL GROUP BY plant"""))
def r59_prod_plant_share(spark, sf_dir):
    g = report(production_prepared(spark, sf_dir), "plant", [S.sum0(Q).alias("units")])
    return with_share(g, "units", "share_pct").withColumn("share_pct", S.rnd("share_pct"))


@query("x02_prod_monthly", _psql(f"""
SELECT date_trunc('month', timestamp) AS month, count(*) AS batches, CAST(sum({Q}) AS BIGINT) AS units
FROM prod WHERE timestamp IS NOT NULL GROUP BY 1"""))
def x02_prod_monthly(spark, sf_dir):
    """X02 month period: monthly production volume."""
    return report(production_prepared(spark, sf_dir), "month",
                  [F.count(F.lit(1)).alias("batches"), S.sum0(Q).alias("units")])
