import datetime as dt

from pyspark.sql import functions as F

from larder.functions import derive as D
from larder.functions import semantics as S
from larder.operators.report import report


def test_null_keys_dropped_and_sum0(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 3)], "k string, v long")
    out = report(df, "k", [S.sum0("v").alias("s")]).collect()
    assert [(r.k, r.s) for r in out] == [("a", 0)]


def test_ratio_zero_and_pct(spark):
    r = spark.range(1).select(S.ratio(F.lit(1), F.lit(0)).alias("a"), S.pct(F.lit(1), F.lit(4)).alias("b")).first()
    assert r.a is None and r.b == 25.0


def test_mode_tie_smallest_and_first_last(spark):
    df = spark.createDataFrame([("g", "b", 2), ("g", "a", 3), ("g", None, 1), ("g", "b", 4), ("g", "a", 5)],
                               "k string, v string, o int")
    r = df.groupBy("k").agg(S.mode_det("v").alias("m"), S.first_nonnull("v", "o").alias("f"),
                            S.last_nonnull("v", "o").alias("l")).first()
    assert (r.m, r.f, r.l) == ("a", "b", "a")


def test_floor_days_and_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(S.floor_days("b", "a").alias("d"), S.weekday0("a").alias("w")).first()
    assert r.d == -1 and r.w == 1   # 2024-01-02 is a Tuesday (Monday = 0)


def test_delay_buckets_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-30.0, -29.0, 0.0, 30.0, 31.0, 60.0, 61.0)], "d double")
    got = [(r.d, r.cat, r.ot) for r in df.select("d", D.delay_category("d").alias("cat"), D.on_time("d").alias("ot")).collect()]
    assert got == [(-30.0, "very_early", 1), (-29.0, "early", 1), (0.0, "early", 1), (30.0, "on_time", 1),
                   (31.0, "late", 0), (60.0, "late", 0), (61.0, "very_late", 0)]


def test_route_type_cut_is_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 30.0, 30.5, 60.0, 150.0, 151.0)], "km double")
    got = [r.t for r in df.select(D.route_type("km").alias("t")).collect()]
    assert got == [None, "Urban", "Suburban", "Suburban", "Rural", None]


def test_money_sum_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(0.2,)] * 10, "x double")
    assert df.agg(S.money_sum("x").alias("s")).first().s == 3.0
