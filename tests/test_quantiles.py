"""Distributed rank selection against pandas and against Spark's percentile."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators.quantiles import exact_quantiles

PROBS, NAMES = [0.0, 0.25, 0.5, 0.9, 1.0], ["least", "q1", "median", "p90", "most"]


def frame(spark):
    rng = np.random.default_rng(4)
    parts = {"even": rng.random(3000), "tail": np.exp(rng.normal(0, 40, 2500)), "ties": rng.integers(0, 3, 2000) * 0.1, "one": np.full(1500, 7.0),
             "two": np.r_[np.full(900, -1.0), np.full(901, 1e300)], "huge": np.r_[rng.uniform(-1, 1, 500) * 1.7e308, [1.7e308, -1.7e308]], "few": np.array([3.0, 1.0, 2.0]),
             "zero": np.r_[np.zeros(400), -np.zeros(400), rng.normal(0, 1e-300, 400)]}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": np.where(np.isfinite(v), v, 0.0)}) for k, v in parts.items()])
    more = pd.DataFrame({"k": ["even", "none", None, "few"], "v": [None, None, 5.0, None]})
    return pdf, spark.createDataFrame(pd.concat([pdf, more]).astype(object).where(lambda d: d.notna(), None), "k string, v double").repartition(6)


def close(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-320)


@pytest.mark.parametrize("limit", [30, 100_000])
def test_by_key(spark, limit):
    pdf, df = frame(spark)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, NAMES, limit).collect()}
    assert set(got) == set(pdf["k"])
    for k, g in pdf.groupby("k"):
        assert got[k]["n"] == len(g)
        for p, name in zip(PROBS, NAMES):
            v = np.sort(g["v"].to_numpy(float))
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            want = lo if lo == hi or at == int(at) else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
            assert close(got[k][name], want), (k, name, got[k][name], want)


def test_without_keys_and_like_percentile(spark):
    _, df = frame(spark)
    df = df.where("k <> 'huge' and k <> 'tail'")
    want = df.agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).first()["q"]
    for limit in (500, 100_000):
        got = exact_quantiles(df, [], "v", PROBS, NAMES, limit).collect()
        assert [[r[n] for n in NAMES] for r in got] == [want]
    assert exact_quantiles(df.limit(0), [], "v", PROBS, NAMES, 50).count() == 0


def test_infinities_take_part(spark):
    df = spark.createDataFrame([(float("inf"),)] * 60 + [(float("-inf"),)] * 60 + [(float(i),) for i in range(61)] + [(float("nan"),)], "v double")
    r = exact_quantiles(df, [], "v", [0.0, 0.5, 1.0], ["a", "b", "c"], 10).first()
    assert tuple(r) == (181, float("-inf"), 30.0, float("inf"))


def test_no_task_holds_a_hot_key(spark):
    """One key, a million distinct values: the shuffles carry bins, and the values of an interval."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    seen = []
    from larder.operators import quantiles as Q

    written = Q.written

    def counting(table, name):
        out = written(table, name)
        seen.append(out.count())
        return out

    Q.written = counting
    try:
        r = exact_quantiles(df, ["k"], "v", [0.5], ["m"], 1000).first()
    finally:
        Q.written = written
    v = np.sort(np.arange(1_000_000) * 7919 % 1_000_003)
    assert r["m"] == (v[499_999] + v[500_000]) / 2 and max(seen) <= 4


def test_ranks_and_shares_without_a_window_over_all(spark):
    from larder.operators.ranking import top_shares, with_rank

    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 613).cast("double").alias("v")).repartition(5)
    got = {r["k"]: r["place"] for r in with_rank(df, [F.col("v").desc(), F.col("k")], "place").collect()}
    want = sorted(range(5000), key=lambda k: (-(k * 7919 % 613), k))
    assert got == {k: i for i, k in enumerate(want, 1)}
    assert with_rank(df.limit(0), [F.col("k")], "place").count() == 0
    v = [k * 7919 % 613 for k in want]
    r = top_shares(df, "v", "k", [1, 40]).first()
    assert r["keys"] == 5000 and abs(r["top1"] - 100 * v[0] / sum(v)) < 1e-9 and abs(r["top40"] - 100 * sum(v[:40]) / sum(v)) < 1e-9
