"""As-of join against a scan per row: ties, gaps over many blocks, hot keys, nulls."""

import datetime as dt
import random

import pytest

from larder.operators import asof

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def brute(left, right, tolerance=None):
    out = []
    for i, k, t in left:
        best = max(((s, n, v) for k2, s, n, v in right if k is not None and k2 == k and t is not None and s is not None and s <= t), default=None)
        if best and tolerance is not None and (t - best[0]) * 60 > tolerance:
            best = None
        out.append((i, k, at(t), best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance", [None, 3600])
@pytest.mark.parametrize("block", [None, 60_000_000, 7 * 86_400_000_000])
def test_against_a_scan_per_row(spark, tolerance, block, monkeypatch):
    monkeypatch.setattr(asof, "SPAN", 4)  # gaps reach over spans too
    rng = random.Random(5)
    when = lambda: rng.choice([None, rng.randrange(200), 3000 + rng.randrange(50), 9000 + rng.randrange(3)])
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), when()) for i in range(300)] + [(900, "only left", 5), (901, "hot", -100)]
    right = [(key(), when(), n, n / 4) for n in range(200)] + [("hot", 100, 1000 + n, 0.5) for n in range(5)] + [("only right", 1, 7, 7.0)]
    l = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i int, k string, t timestamp_ntz")
    r = spark.createDataFrame([(k, at(s), n, v) for k, s, n, v in right], "k string, s timestamp_ntz, n int, v double")
    got = asof.asof_join(l.repartition(3), r.repartition(2), ["k"], "t", "s", "n", ["n", "v"], tolerance, block)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(left, right, tolerance)


def test_empty_sides_and_clashing_names(spark):
    l = spark.createDataFrame([(1, "a", START)], "i int, k string, t timestamp_ntz")
    r = spark.createDataFrame([], "k string, s timestamp_ntz, n int, v double")
    assert [tuple(x) for x in asof.asof_join(l, r, ["k"], "t", "s", "n", ["n", "v"]).collect()] == [(1, "a", START, None, None)]
    assert asof.asof_join(l.limit(0), r, ["k"], "t", "s", "n", ["n", "v"]).count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(l.withColumnRenamed("i", "n"), r, ["k"], "t", "s", "n", ["n"])


def test_blocks_follow_the_fullest_day(spark):
    rows = spark.createDataFrame([("hot", i * 1000) for i in range(1000)] + [("a", 5)], "k string, at long")
    assert asof.block_length(rows, ["k"], "at", 100) == asof.DAY // 10
    assert asof.block_length(rows.limit(0), ["k"], "at") == asof.DAY


def test_checks_are_joined_once(spark):
    from larder.plans import QUERIES

    for name in ("p03_qc_sensor_asof", "p03_reading_by_status"):
        files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("lineitem" in f or "orders" in f for f in files), name
