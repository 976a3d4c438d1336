"""Streams give the same result from a file, a folder and shuffled files."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from larder.streaming import streams as ST

JOBS = {"events": [ST.sensor_hourly_stream, ST.delay_rolling_stream, ST.zscore_alert_stream], "lineitem": [ST.ledger_alert_stream]}


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    folder, mixed = tmp_path_factory.mktemp("folder"), tmp_path_factory.mktemp("mixed")
    for name in os.listdir(SMALL):
        t = spark.read.parquet(f"{SMALL}/{name}")
        t.write.parquet(f"{folder}/{name}")
        t.orderBy(F.rand(7)).repartition(5).write.parquet(f"{mixed}/{name}")
    return str(folder), str(mixed)


@pytest.mark.parametrize("job", [j for v in JOBS.values() for j in v], ids=lambda j: j.__name__)
def test_same_rows_from_every_layout(spark, layouts, job, monkeypatch):
    want = rows(job(spark, SMALL))
    if job is not ST.zscore_alert_stream:  # few alerts, or none, on the smallest tables
        assert want
    whole = ST.table_stream
    monkeypatch.setattr(ST, "table_stream", lambda s, d, n, files_per_batch=1: whole(s, d, n, files_per_batch))
    for d in layouts:
        assert rows(job(spark, d)) == want


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    base = str(tmp_path / "run")
    first = rows(ST.sensor_hourly_stream(spark, SMALL, base))
    assert rows(ST.sensor_hourly_stream(spark, SMALL, base)) == first
