"""A sample of registered queries vs their DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SAMPLE = ["r13_pos_by_region", "r41_inv_by_sku", "a27_pos_sku_region_pivot", "a42_sensor_value_histogram",
          "w01_dispatch_rolling", "w02_route_zscore", "r62_qc_by_batch", "p04_ledger_reconcile",
          "r84_routes_by_type", "m02_zscore_folds", "st4_ledger_alert_stream", "p03_qc_sensor_asof", "p09_promotion_effects",
          "p13_forecast_coefficients", "p13_forecast_errors", "s06_clean_returns", "s09_metrics_table", "s11_dispatch_sample_by_route", "s15_rewrite_and_rollback",
          "st1_sensor_hourly_watermark", "v06_distance_stops_grid", "v09_route_daily_mean"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.fixture(scope="module")
def con():
    k = duckdb.connect()
    for t in TABLES:
        k.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return k


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, rel.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
