"""Anomaly detection and evaluation over the dispatch feature table: M01-M06, M10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import semantics as S
from larder.operators.anomaly import global_zscore
from larder.operators.iforest import cv_report, feature_columns, isolation_forest
from larder.plans.dispatch import DELAY, _dsql, dispatch_features, dispatch_prepared
from larder.plans.registry import query
from larder.session import checkpoint_dir, ship_package

c = F.col

# Identifier and label columns never used as model features.
NON_FEATURES = ["dispatch_id", "anomaly", "label", "is_anomaly"]


def materialised_features(spark, sf_dir) -> DataFrame:
    """The feature table, checkpointed to the cluster's shared checkpoint folder.

    Fit, scoring and fold statistics all read it; the checkpoint cuts the
    lineage so the rolling windows run once and a lost executor re-reads the
    files instead of recomputing the windows.
    """
    checkpoint_dir(spark)
    ship_package(spark)
    return dispatch_features(spark, sf_dir).checkpoint(eager=True)


_SEG_SQL = """
, dates AS (SELECT DISTINCT CAST(timestamp AS DATE) AS date FROM d WHERE timestamp IS NOT NULL),
nd AS (SELECT CASE WHEN count(*) < 5 THEN greatest(2, count(*)) ELSE 5 END AS n FROM dates),
seg AS (SELECT date, ntile((SELECT n FROM nd)) OVER (ORDER BY date) AS segment FROM dates),
r AS (SELECT d.*, segment FROM d JOIN seg ON CAST(d.timestamp AS DATE) = seg.date),
folds AS (SELECT DISTINCT segment AS fold FROM seg WHERE segment < (SELECT max(segment) FROM seg)),
tr AS (SELECT fold, count(*) AS n_train, avg(dispatch_delay_minutes) AS m,
              CASE WHEN stddev_samp(dispatch_delay_minutes) > 0 THEN stddev_samp(dispatch_delay_minutes) ELSE 1.0 END AS sd
       FROM folds JOIN r ON r.segment <= folds.fold GROUP BY fold),
te AS (SELECT fold, count(*) AS n_test FROM folds JOIN r ON r.segment = folds.fold + 1 GROUP BY fold)
"""


@query("m01_time_splits", _dsql(_SEG_SQL + """
SELECT CAST(tr.fold AS INT) AS fold, n_train, n_test FROM tr JOIN te ON tr.fold = te.fold"""))
def m01_time_splits(spark, sf_dir):
    from larder.operators.anomaly import zscore_folds
    z = zscore_folds(dispatch_prepared(spark, sf_dir), "timestamp", DELAY, 5)
    return z.select(c("fold").cast("int").alias("fold"), "n_train", "n_test")


@query("m02_zscore_folds", _dsql(_SEG_SQL + """
, zc AS (SELECT te.fold, count(*) FILTER (WHERE abs((r.dispatch_delay_minutes - tr.m) / tr.sd) > 3) AS z_anomalies
         FROM te JOIN tr ON te.fold = tr.fold JOIN r ON r.segment = te.fold + 1 GROUP BY te.fold)
SELECT CAST(tr.fold AS INT) AS fold, n_train, n_test, round(m, 6) AS train_mean, round(sd, 6) AS train_std,
       coalesce(z_anomalies, 0) AS z_anomalies
FROM tr JOIN te ON tr.fold = te.fold LEFT JOIN zc ON zc.fold = tr.fold"""))
def m02_zscore_folds(spark, sf_dir):
    from larder.operators.anomaly import zscore_folds
    z = zscore_folds(dispatch_prepared(spark, sf_dir), "timestamp", DELAY, 5)
    return z.select(c("fold").cast("int").alias("fold"), "n_train", "n_test",
                    S.rnd("train_mean").alias("train_mean"), S.rnd("train_std").alias("train_std"),
                    "z_anomalies")


@query("m06_fold_report")
def m06_fold_report(spark, sf_dir):
    feats = materialised_features(spark, sf_dir)
    cols = feature_columns(feats, NON_FEATURES)
    return cv_report(feats, cols, ["dispatch_id"], DELAY, n_trees=100, contamination=0.02)


def scored_features(spark, sf_dir) -> DataFrame:
    """M03 + M05 on the full table: 200 trees, contamination 0.02, seed 42."""
    feats = materialised_features(spark, sf_dir)
    cols = feature_columns(feats, NON_FEATURES)
    scored = isolation_forest(feats, cols, ["dispatch_id"], feats.columns, n_trees=200, contamination=0.02)
    return global_zscore(scored, DELAY, "delay_zscore", 3.0, "z_anomaly")


@query("m05_isolation_forest_scores")
def m05_isolation_forest_scores(spark, sf_dir):
    return scored_features(spark, sf_dir).select("dispatch_id", "if_score", "if_anomaly", "delay_zscore", "z_anomaly")


@query("m10_flag_top")
def m10_flag_top(spark, sf_dir):
    """Top 1,000 rows by isolation-forest score (T05: TakeOrderedAndProject)."""
    return scored_features(spark, sf_dir).orderBy(c("if_score").desc(), c("dispatch_id")).limit(1000)
