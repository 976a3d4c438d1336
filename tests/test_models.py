import numpy as np
from pyspark.sql import functions as F

from larder.operators.anomaly import global_zscore
from larder.operators.iforest import avg_path_length, isolation_forest


def test_avg_path_length():
    assert avg_path_length([1, 2])[0] == 0.0 and avg_path_length([2])[0] == 1.0
    assert abs(avg_path_length([256])[0] - 10.244) < 1e-3


def test_planted_outliers_rank_first(spark):
    rng = np.random.RandomState(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, size=(2000, 2)))]
    rows += [(5000 + j, 12.0 + j, -12.0 - j) for j in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    scored = isolation_forest(df, ["a", "b"], ["id"], ["id"], n_trees=50, contamination=0.01)
    top = [r.id for r in scored.orderBy(F.col("if_score").desc()).limit(5).collect()]
    assert set(top) == set(range(5000, 5005))
    again = isolation_forest(df.repartition(3), ["a", "b"], ["id"], ["id"], n_trees=50, contamination=0.01)
    a = {r.id: r.if_anomaly for r in scored.collect()}
    b = {r.id: r.if_anomaly for r in again.collect()}
    assert a == b                                 # independent of partitioning


def test_global_zscore_zero_std(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    out = global_zscore(df, "x", "z", 3.0, "flag").collect()
    assert all(r.z == 0.0 and r.flag is False for r in out)
