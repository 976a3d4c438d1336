import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators.anomaly import fold_segments
from larder.operators.rolling import rolling_time_stats_blocked
from larder.operators.windows import centered_moving_average, rolling_time_stats


def _frame(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        ts = t0 + dt.timedelta(hours=13 * i) if i % 11 else None
        rows.append((i, "k1" if i % 3 else "k2", ts, float((i * 7) % 23)))
    rows += [(100, "k1", t0 + dt.timedelta(days=3), 5.0), (101, "k1", t0 + dt.timedelta(days=3), 9.0),
             (102, None, t0, 1.0), (103, "k2", t0 + dt.timedelta(days=10), None)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")


def test_blocked_equals_plain_window(spark):
    df = _frame(spark)
    plain = df
    for w in ("7D", "30D"):
        plain = rolling_time_stats(plain, "k", "ts", "v", w)
    blocked = rolling_time_stats_blocked(df, "k", "ts", "v", ("7D", "30D"), id_col="id")
    cols = [x for x in plain.columns if x not in df.columns]
    a = {r.id: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in plain.collect()}
    b = {r.id: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in blocked.collect()}
    assert a == b


def test_moving_average_needs_full_frame(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "d int, u double")
    assert all(r.ma is None for r in centered_moving_average(df, "d", "u", 7, "ma").collect())
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "d int, u double")
    got = {r.d: r.ma for r in centered_moving_average(df, "d", "u", 7, "ma").collect()}
    assert got[3] == 3.0 and got[2] is None


def test_segments_array_split_rule(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(days=i),) for i in range(7)], "ts timestamp_ntz")
    segs = [r.segment for r in fold_segments(df, "ts", 5).orderBy("date").collect()]
    assert segs == [1, 1, 2, 2, 3, 4, 5]
    df3 = spark.createDataFrame([(t0 + dt.timedelta(days=i),) for i in range(3)], "ts timestamp_ntz")
    assert [r.segment for r in fold_segments(df3, "ts", 5).orderBy("date").collect()] == [1, 2, 3]


def test_sliced_windows_equal_plain_and_bounded_tasks(spark, monkeypatch):
    from larder.operators import rolling

    t0, rows = dt.datetime(2024, 1, 1), []
    for i in range(900):
        k = "hot" if i % 9 else "cold"
        v = None if i % 41 == 0 else float((i * 7919) % 211) if i < 500 else 5.0 if i < 650 else float(i % 3) * 1e6
        rows.append((i, k, t0 + dt.timedelta(minutes=67 * (i - i % 4)), v))
    rows += [(1000, "hot", None, 1.0), (1001, None, t0, 1.0), (1002, "void", t0, None), (1003, "hot", t0 - dt.timedelta(days=90), 2.5)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double").repartition(3)
    plain = df
    for w in ("7D", "30D"):
        plain = rolling_time_stats(plain, "k", "ts", "v", w)
    cols = [x for x in plain.columns if x not in df.columns]
    want = {r.id: [r[c] for c in cols] for r in plain.collect()}
    sent = []
    held = rolling.if_small

    def seen(table, *a):
        sent.append(table.columns)
        return held(table, *a)

    monkeypatch.setattr(rolling, "if_small", seen)
    for size in (12, 50_000):
        got = rolling_time_stats_blocked(df, "k", "ts", "v", ("7D", "30D"), slice_rows=size)
        got = {r.id: [r[c] for c in cols] for r in got.collect()}
        assert got.keys() == want.keys()
        for i, row in want.items():
            assert got[i] == [None if x is None else pytest.approx(x, rel=1e-9, abs=1e-9) for x in row], (size, i)
    assert ["k", "to", "bin"] in sent  # the windows had a core


def test_a_slice_gets_few_values_of_a_long_window(spark):
    """100,000 rows in a window, slices of 1,000: no task gets more than some thousands."""
    from larder.operators import rolling
    from larder.operators.asof import DAY

    n = 100_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * (30 * DAY // n)).alias("t"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    m = rolling._slices(rows, 30, 1000).first()["m"]
    assert m == 128
    rows = rows.withColumns({"m": F.lit(m), "j": rolling._whole(F.col("t"), F.lit(30 * DAY // m))})
    assert rolling._core(rows, "string").groupBy("k", "j").count().agg(F.max("count")).first()[0] < 5000
