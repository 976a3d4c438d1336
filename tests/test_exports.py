"""Files, versions, fingerprints, samples, saved models, grids and forecasts."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import forecast as O
from larder.operators.fingerprint import column_fingerprints, fingerprint
from larder.operators.frames import scatter_frame
from larder.operators.modelstore import Forest, cached_forest, store_scores
from larder.operators.sampling import sample, stratified_sample
from larder.session import ship_package
from larder.sources.publish import TooLarge, publish_csv, publish_json, read_report
from larder.sources.versions import VersionConflict, VersionedTable


# --- one-file reports
def test_exact_bytes_and_round_trip(spark, tmp_path):
    rows = [(2, "b, \"q\"", None, dt.datetime(2024, 1, 2, 3, 4, 5, 600)), (1, "", 0.1, None), (3, None, -2.5e-9, None)]
    df = spark.createDataFrame(rows, "id int, name string, x double, t timestamp_ntz").repartition(3)
    path = publish_csv(df, f"{tmp_path}/report.csv", order=["id"])
    assert open(path, "rb").read() == b'id,name,x,t\n1,"",0.1,\n2,"b, ""q""",,2024-01-02 03:04:05.000600\n3,,-2.5E-9,\n'
    assert sorted(map(tuple, read_report(spark, path, df.schema).collect())) == sorted(rows)
    path = publish_json(df, f"{tmp_path}/report.json", order=["id"])
    assert open(path).read().splitlines()[0] == '{"id":1,"name":"","x":0.1,"t":null}'
    assert sorted(map(tuple, read_report(spark, path, df.schema, "json").collect())) == sorted(rows)


def test_replaced_whole_refused_when_large_and_empty(spark, tmp_path):
    path = f"{tmp_path}/r.csv"
    publish_csv(spark.range(3), path)
    publish_csv(spark.range(2), path)
    assert open(path).read() == "id\n0\n1\n"
    with pytest.raises(TooLarge):
        publish_csv(spark.range(11), path, max_rows=10)
    assert open(path).read() == "id\n0\n1\n"
    publish_csv(spark.range(0), path)
    assert open(path).read() == "id\n"
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["r.csv"]


# --- versions
def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(spark.range(3)) == 1
    t.stage(spark.range(100))  # written, never published
    assert t.versions() == [1] and t.read().count() == 3


def test_rewrite_from_itself_pinned_readers_and_rollback(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.write(spark.range(4).withColumn("x", F.col("id") * 2))
    old = t.read()
    assert t.write(t.read().where("id > 1").drop("x")) == 2
    assert t.read().columns == ["id"] and t.read().count() == 2 and old.count() == 4
    assert t.rollback(1) == 3 and t.read().count() == 4 and t.manifest()["origin"] == "rollback to 1"
    assert [t.read(v).count() for v in t.versions()] == [4, 2, 4]


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.write(spark.range(1))
    mine, other = t.stage(spark.range(2)), VersionedTable(spark, f"{tmp_path}/t")
    assert other.write(spark.range(5), after=1) == 2
    with pytest.raises(VersionConflict):
        t.publish(mine, after=1)
    assert t.versions() == [1, 2] and t.read().count() == 5


# --- fingerprints and saved models
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b string")


def test_fingerprints_tell_content_not_order(spark):
    rows = [(i, float(i % 7) if i % 5 else None, "xy"[i % 2]) for i in range(200)]
    base = fingerprint(table(spark, rows))
    shuffled = random.Random(1).sample(rows, len(rows))
    assert fingerprint(table(spark, shuffled).repartition(7)) == base
    assert fingerprint(table(spark, rows).select("b", "id", "a")) == base
    one = [*rows[:-1], (199, 3.5, rows[-1][2])]
    swapped = [(rows[0][0], rows[0][1], rows[1][2]), (rows[1][0], rows[1][1], rows[0][2]), *rows[2:]]  # two cells of a column change places
    nulls = [(0, 0.0, None), *rows[1:]]
    for other in (one, swapped, nulls, rows[:-1], [*rows, rows[0]]):
        assert fingerprint(table(spark, other)) != base
    assert fingerprint(table(spark, rows).withColumnRenamed("a", "c")) != base
    assert [r["n_rows"] for r in column_fingerprints(table(spark, [])).collect()] == [0] * 4


def test_a_saved_forest_scores_alike_and_is_found_by_content(spark, tmp_path):
    ship_package(spark)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    root = str(tmp_path / "models")
    first, known = cached_forest(df, ["x", "y"], ["id"], root, n_trees=20)
    again, hit = cached_forest(df.orderBy("x").coalesce(1), ["x", "y"], ["id"], root, n_trees=20)
    assert (known, hit) == (False, True) and again.key == first.key
    want = {r["id"]: r["if_score"] for r in first.score(df, ["id"]).collect()}
    assert {r["id"]: r["if_score"] for r in Forest.load(spark, root, first.key).score(df, ["id"]).collect()} == want
    assert max(want, key=want.get) == 999
    assert not cached_forest(df.where("id > 0"), ["x", "y"], ["id"], root, n_trees=20)[1]
    assert Forest.load(spark, root, "no such key") is None


def test_only_stored_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "scores")
    store_scores(spark.createDataFrame([(1, 0.5, "a"), (2, 0.6, "b")], "id int, s double, day string"), path, "day")
    out = store_scores(spark.createDataFrame([(3, 0.7, "b")], "id int, s double, day string"), path, "day")
    assert sorted(map(tuple, out.collect())) == [(1, 0.5, "a"), (3, 0.7, "b")]


# --- samples
def hashed(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_samples_do_not_depend_on_partitions(spark):
    keys = ["hot"] * 3000 + ["a"] * 40 + [None] * 30 + ["one"]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    want = sorted(range(len(keys)), key=hashed)[:100]
    got = {tuple(sorted(r["id"] for r in sample(df.repartition(n), ["id"], 100).collect())) for n in (1, 7)}
    assert got == {tuple(sorted(want))}
    want = sorted(i for k in set(keys) for i in sorted((i for i, x in enumerate(keys) if x == k), key=hashed)[:25])
    got = {tuple(sorted(r["id"] for r in stratified_sample(df.repartition(n), "k", ["id"], 25).collect())) for n in (1, 7)}
    assert got == {tuple(want)}
    assert stratified_sample(df.limit(0), "k", ["id"], 5).count() == 0 and sample(df, ["id"], 10, 1).collect() != sample(df, ["id"], 10, 2).collect()


def test_a_stratum_with_too_few_rows_below_its_mark_is_taken_whole(spark, monkeypatch):
    from larder.operators import sampling
    monkeypatch.setattr(sampling, "SPAN", 1)  # marks that let nothing pass
    df = spark.range(500).withColumn("k", F.col("id") % 2)
    got = sorted(r["id"] for r in stratified_sample(df, "k", ["id"], 10).collect())
    assert got == sorted(i for k in (0, 1) for i in sorted(range(k, 500, 2), key=hashed)[:10])


# --- grids
def test_grid_is_bounded_and_keeps_the_extremes(spark):
    df = spark.range(20_000).select((F.col("id") % 317).cast("double").alias("x"), (F.col("id") * 7 % 1009).cast("double").alias("y"))
    g = scatter_frame(df, "x", "y", 8).collect()
    assert len(g) <= 64 and sum(r["points"] for r in g) == 20_000
    assert (min(r["min_x"] for r in g), max(r["max_x"] for r in g), max(r["max_y"] for r in g)) == (0, 316, 1008)
    flat = scatter_frame(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 1.0)], "x double, y double"), "x", "y", 5).collect()
    assert [(r["cell_x"], r["cell_y"], r["points"]) for r in flat] == [(0, 0, 2)]
    assert scatter_frame(df.limit(0), "x", "y", 5).count() == 0


# --- forecasts
def test_least_squares_of_every_origin(spark):
    rng = np.random.default_rng(3)
    start, rows = dt.date(2024, 1, 1), []
    for s, n in (("a", 200), ("b", 200)):
        rows += [(s, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.integers(0, 50, n)) if i % 11]
    rows += [("flat", start + dt.timedelta(days=i), 4.0) for i in range(200)] + [(None, start, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    f = ["lag1", "lag7", "weekend"]
    lagged = O.with_fold(O.lag_features(O.daily_series(df, "k", "d", "v"), "k", "d", "v"), "d", 3, 28)
    coefficients = O.solve(O.equations_by_fold(O.equation_blocks(lagged, "k", "v", f), "k", 3), ["k", "fold"], "v", f)
    errors = {(r["k"], r["fold"]): r for r in O.rolling_origin_errors(lagged, coefficients, "k", "v", f).collect()}
    pdf = lagged.toPandas()
    for r in coefficients.collect():
        train, test = pdf[(pdf["k"] == r["k"]) & (pdf["part"] < r["fold"])], pdf[(pdf["k"] == r["k"]) & (pdf["part"] == r["fold"])]
        assert r["n"] == len(train) and len(test) == 28
        e = errors[r["k"], r["fold"]]
        assert abs(e["mae_naive"] - (test["v"] - test["lag7"]).abs().mean()) < 1e-9
        if r["k"] == "flat":  # nothing to tell apart
            assert r["b_lag1"] is None and r["intercept"] is None and e["mae_model"] is None
            continue
        x = np.c_[np.ones(len(train)), train[f]]
        want = np.linalg.lstsq(x, train["v"], rcond=None)[0]
        assert np.allclose([r["intercept"], *(r[f"b_{n}"] for n in f)], want, atol=1e-8)
        assert abs(e["mae_model"] - np.abs(test["v"] - np.c_[np.ones(28), test[f]] @ want).mean()) < 1e-8
    assert O.solve(O.equations_by_fold(O.equation_blocks(lagged.limit(0), "k", "v", f), "k", 3), ["k", "fold"], "v", f).count() == 0
