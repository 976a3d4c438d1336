"""Quality-control reports: C14, C35, A14, A15, A36, R60-R66."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.report import report
from larder.plans.oracle_views import osql
from larder.plans.registry import query
from larder.sources.fixtures import fx_qc

c = F.col


def qc_prepared(spark, sf_dir) -> DataFrame:
    df = fx_qc(spark, sf_dir)
    st = D.normalise_status("pass_fail")
    return df.withColumns({
        "status": st, "is_pass": (st == "pass").cast("int"), "is_fail": (st == "fail").cast("int"),
        "hour": F.hour("timestamp"), "date": F.to_date("timestamp")})


QC_SQL = """WITH qc AS (
  SELECT *, lower(trim(pass_fail)) AS status, CAST(lower(trim(pass_fail)) = 'pass' AS INT) AS is_pass,
         CAST(lower(trim(pass_fail)) = 'fail' AS INT) AS is_fail, hour(timestamp) AS hour,
         CAST(timestamp AS DATE) AS date
  FROM fx_qc)
"""


def _qsql(body):
    return osql("fx_qc", QC_SQL + body)


_COUNTS_SQL = """count(qc_id) AS total_checks, CAST(sum(is_pass) AS BIGINT) AS passed, CAST(sum(is_fail) AS BIGINT) AS failed"""


def _counts():
    return [F.count("qc_id").alias("total_checks"), S.sum0("is_pass").alias("passed"), S.sum0("is_fail").alias("failed")]


def _fail_rate():
    return S.rnd(S.pct("failed", "total_checks")).alias("fail_rate_pct")


@query("r60_qc_by_parameter", _qsql(f"""
SELECT parameter, {_COUNTS_SQL}, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
       round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, count(DISTINCT batch_id) AS batches,
       round(sum(is_fail) * 100.0 / count(qc_id), 6) AS fail_rate_pct
FROM qc WHERE parameter IS NOT NULL GROUP BY parameter"""))
def r60_qc_by_parameter(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "parameter", _counts() + [
        S.rnd(F.avg("value")).alias("value_mean"), S.rnd(F.stddev_samp("value")).alias("value_std"),
        S.rnd(F.min("value")).alias("value_min"), S.rnd(F.max("value")).alias("value_max"),
        S.nunique("batch_id").alias("batches")])
    return g.withColumn("fail_rate_pct", _fail_rate()).orderBy(c("fail_rate_pct").desc(), "parameter")


@query("r61_qc_by_sku", _qsql(f"""
SELECT sku, {_COUNTS_SQL}, count(DISTINCT batch_id) AS batches,
       round(sum(is_fail) * 100.0 / count(qc_id), 6) AS fail_rate_pct
FROM qc WHERE sku IS NOT NULL GROUP BY sku"""))
def r61_qc_by_sku(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "sku", _counts() + [S.nunique("batch_id").alias("batches")])
    return g.withColumn("fail_rate_pct", _fail_rate())


@query("r62_qc_by_batch", _qsql(f"""
SELECT batch_id, {_COUNTS_SQL},
       arg_min(sku, (qc_id, sku)) FILTER (WHERE sku IS NOT NULL) AS sku,
       arg_min(timestamp, (qc_id, timestamp)) FILTER (WHERE timestamp IS NOT NULL) AS timestamp,
       CASE WHEN sum(is_fail) > 0 THEN 'FAILED' ELSE 'PASSED' END AS batch_status,
       round(sum(is_fail) * 100.0 / count(qc_id), 6) AS fail_rate_pct
FROM qc WHERE batch_id IS NOT NULL GROUP BY batch_id"""))
def r62_qc_by_batch(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "batch_id", _counts() + [
        S.first_nonnull("sku", "qc_id", "sku").alias("sku"),
        S.first_nonnull("timestamp", "qc_id", "timestamp").alias("timestamp")])
    # A batch fails when any of its checks failed.
    return g.withColumns({"batch_status": F.when(c("failed") > 0, "FAILED").otherwise("PASSED"),
                          "fail_rate_pct": _fail_rate()})


@query("r63_qc_failed_detail", _qsql("""
SELECT batch_id, sku, parameter, count(qc_id) AS fail_count, round(avg(value), 6) AS mean_value,
       round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
       coalesce(array_to_string(list_slice(list_sort(list_distinct(list(notes) FILTER (WHERE notes IS NOT NULL))), 1, 3), ' | '), '') AS notes_sample
FROM qc WHERE is_fail = 1 AND batch_id IS NOT NULL AND sku IS NOT NULL AND parameter IS NOT NULL
GROUP BY batch_id, sku, parameter"""))
def r63_qc_failed_detail(spark, sf_dir):
    df = qc_prepared(spark, sf_dir).where(c("is_fail") == 1)
    return report(df, ["batch_id", "sku", "parameter"], [
        F.count("qc_id").alias("fail_count"), S.rnd(F.avg("value")).alias("mean_value"),
        S.rnd(F.min("value")).alias("min_value"), S.rnd(F.max("value")).alias("max_value"),
        # Three smallest distinct notes (sorted for determinism), joined.
        F.array_join(F.slice(F.array_sort(F.collect_set("notes")), 1, 3), " | ").alias("notes_sample"),
    ], order=[c("fail_count").desc()])


@query("r64_qc_by_hour", _qsql(f"""
SELECT hour, {_COUNTS_SQL}, round(sum(is_fail) * 100.0 / count(qc_id), 6) AS fail_rate_pct
FROM qc WHERE hour IS NOT NULL GROUP BY hour"""))
def r64_qc_by_hour(spark, sf_dir):
    return report(qc_prepared(spark, sf_dir), "hour", _counts()).withColumn("fail_rate_pct", _fail_rate())


@query("r65_qc_by_date", _qsql(f"""
SELECT date, {_COUNTS_SQL}, count(DISTINCT batch_id) AS batches, round(sum(is_fail) * 100.0 / count(qc_id), 6) AS fail_rate_pct
FROM qc WHERE date IS NOT NULL GROUP BY date"""))
def r65_qc_by_date(spark, sf_dir):
    g = report(qc_prepared(spark, sf_dir), "date", _counts() + [S.nunique("batch_id").alias("batches")])
    return g.withColumn("fail_rate_pct", _fail_rate())


@query("r66_qc_overview", _qsql("""
, h AS (SELECT hour, sum(is_fail) * 100.0 / count(qc_id) AS r FROM qc WHERE hour IS NOT NULL GROUP BY hour)
SELECT count(*) AS checks, round(avg(is_pass) * 100, 6) AS pass_pct, round(avg(is_fail) * 100, 6) AS fail_pct,
       count(DISTINCT batch_id) AS batches, round(count(*) * 1.0 / count(DISTINCT batch_id), 6) AS checks_per_batch,
       count(DISTINCT batch_id) FILTER (WHERE is_fail = 1) AS failed_batches,
       round(count(DISTINCT batch_id) FILTER (WHERE is_fail = 1) * 100.0 / count(DISTINCT batch_id), 6) AS failed_batch_pct,
       (SELECT arg_max(hour, (r, -hour)) FROM h) AS peak_fail_hour,
       (SELECT arg_min(hour, (r, hour)) FROM h) AS best_hour,
       CASE WHEN avg(is_fail) * 100 > 5 THEN 'high' WHEN avg(is_fail) * 100 > 2 THEN 'elevated' ELSE 'normal' END AS severity
FROM qc"""))
def r66_qc_overview(spark, sf_dir):
    df = qc_prepared(spark, sf_dir)
    fail_pct = S.rate("is_fail")
    overall = df.agg(
        F.count(F.lit(1)).alias("checks"), S.rnd(S.rate("is_pass")).alias("pass_pct"),
        S.rnd(fail_pct).alias("fail_pct"), S.nunique("batch_id").alias("batches"),
        S.rnd(S.ratio(F.count(F.lit(1)), S.nunique("batch_id"))).alias("checks_per_batch"),
        # Distinct batches with a failed check.
        F.countDistinct(F.when(c("is_fail") == 1, c("batch_id"))).alias("failed_batches"),
        S.rnd(S.pct(F.countDistinct(F.when(c("is_fail") == 1, c("batch_id"))), S.nunique("batch_id")))
         .alias("failed_batch_pct"),
        F.when(fail_pct > 5, "high").when(fail_pct > 2, "elevated").otherwise("normal").alias("severity"))
    h = report(df, "hour", _counts()).withColumn("r", S.pct("failed", "total_checks"))
    ext = h.agg(F.max_by("hour", F.struct(c("r"), -c("hour"))).alias("peak_fail_hour"),
                F.min_by("hour", F.struct(c("r"), c("hour"))).alias("best_hour"))
    return overall.crossJoin(ext)


@query("r66_qc_top3_failing_params", _qsql("""
SELECT parameter, CAST(sum(is_fail) AS BIGINT) AS failed FROM qc WHERE parameter IS NOT NULL GROUP BY parameter
ORDER BY failed DESC, parameter LIMIT 3"""))
def r66_qc_top3_failing_params(spark, sf_dir):
    return report(qc_prepared(spark, sf_dir), "parameter", [S.sum0("is_fail").alias("failed")],
                  order=[c("failed").desc()], limit=3)
