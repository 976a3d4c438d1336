"""Watermarked windows: equal to batch where closed, late rows counted, restart in the middle of a run."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from larder.streaming import watermarked as W


def batch(spark, job, sf_dir):
    """All windows, and those that end a grace period before the newest event."""
    rows = job.prepare(spark, sf_dir, None)
    newest = rows.agg((F.unix_micros(F.max("timestamp"))).alias("newest"))
    every = job.windows(rows).crossJoin(newest).where(F.unix_micros("window.end") <= F.col("newest") - F.lit(3_600_000_000 * (24 if "day" in job.grace else 1)))
    return every.select(W._clock(F.col("window.start")).alias("a"), W._clock(F.col("window.end")).alias("b"), *job.keys, F.round(F.try_divide("total", "n"), 6).alias("m"), "n", "rows")


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def split(spark, folder, parts, order="ts"):
    """The events in ``parts`` files, one after the other in time."""
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    pdf = spark.read.parquet(f"{SMALL}/events.parquet").orderBy(order).toPandas()
    step = -(-len(pdf) // parts)
    return [pdf.iloc[i:i + step] for i in range(0, len(pdf), step)]


def put(folder, number, pdf):
    path = f"{folder}/events.parquet/part-{number:03d}.parquet"
    pdf.to_parquet(path, index=False, coerce_timestamps="us")
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.mark.parametrize("job", [W.sensor_hourly, W.delay_rolling], ids=lambda j: j.name)
def test_closed_windows_and_a_restart_in_the_middle(spark, tmp_path, job):
    base, folder = str(tmp_path / "run"), str(tmp_path / "data")
    parts = split(spark, folder, 4)
    for i, p in enumerate(parts[:2]):
        put(folder, i, p)
    first = rows(job.run(spark, folder, base, 1))
    for i, p in enumerate(parts[2:], 2):
        put(folder, i, p)
    # Stopped somewhere in its second run, maybe within a batch; then it goes on.
    q = job.start(spark, folder, base, 1, processingTime="0 seconds")
    q.awaitTermination(4)
    q.stop()
    got = job.run(spark, folder, base, 1)
    want = rows(batch(spark, job, folder))
    assert want and rows(got) == want and set(first) <= set(want)
    assert job.late_rows(spark, folder, base) == 0 and job.open_rows(spark, base) > 0


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    job, base, folder = W.sensor_hourly, str(tmp_path / "run"), str(tmp_path / "data")
    parts = split(spark, folder, 4)
    for i, p in enumerate(parts):
        put(folder, i, p)
    before = rows(job.run(spark, folder, base, 1))
    late = parts[0].head(17).assign(event_id=lambda d: d["event_id"] + 10_000_000)
    put(folder, 9, late)
    assert rows(job.run(spark, folder, base, 1)) == before
    assert job.late_rows(spark, folder, base) == 17


def test_no_events(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert W.sensor_hourly.run(spark, str(tmp_path)).count() == 0
