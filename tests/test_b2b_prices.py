"""Wholesale prices: missing ones filled by exact medians, without a buffer of all prices of a SKU."""

import statistics

from pyspark.sql import functions as F

from larder.operators import quantiles
from larder.operators.quantiles import exact_quantiles
from larder.operators.stages import written
from larder.plans import QUERIES
from larder.plans.b2b import b2b_units, priced

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_fill_by_exact_median_of_large_and_small_skus(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 20)
    prices = {"hot": [float(i * 7919 % 1009) for i in range(500)] + [None], "few": [3.0, 1.0, 2.0, 2.5, None], "none": [None, None], "ties": [4.0] * 60 + [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in prices.items() for v in vs], "sku string, price_per_unit double").repartition(5)
    got = {}
    for r in priced(written(rows, "rows")).collect():
        got.setdefault(r["sku"], []).append(r["price_per_unit"])
    for k, vs in prices.items():
        known = [v for v in vs if v is not None]
        want = [v if v is not None else (statistics.median(known) if known else None) for v in vs]
        assert sorted(got[k], key=str) == sorted(want, key=str), k


def test_price_reports_keep_no_buffer_of_all_prices(spark):
    for name in ("r37_b2b_price_stats", "r32_b2b_overview"):
        df = QUERIES[name](spark, SMALL)
        assert "median(price_per_unit" not in plan(df) and df.count() > 0, name
    assert "percentile" not in plan(b2b_units(spark, SMALL)) and "median" not in plan(b2b_units(spark, SMALL))


def test_quantiles_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    df = spark.range(3000).select((F.col("id") % 1009).alias("v")).withColumn("v", F.udf(seen, "long").asNondeterministic()("v").cast("double"))
    got = exact_quantiles(df, [], "v", [0.5], ["m"], 50).collect()
    assert got[0]["n"] == 3000 and read.value == 3000
