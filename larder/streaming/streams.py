"""Structured Streaming forms of batch jobs (ST1-ST4).

The driver tables are replayed as a file stream over the table's path, be it one Parquet
file or a folder of them. Each job runs with ``trigger(availableNow=True)`` into Parquet
inside the cluster's shared checkpoint folder, and the written table is read back as the
result. Nothing is collected on the driver.

Windowed jobs (ST1, ST2) write partial sums: each micro-batch reduces its rows to one row
a window and key, in a folder named by the batch's number, so a batch that is repeated
after a failure replaces its own output. Partial sums are added up when the table is read.
So no row is ever late: neither the order nor the size of the files changes the result.
A window is complete when the newest event lies at least the grace period behind its end.

* ST1 hourly sensor means, grace 1 hour.
* ST2 rolling delay per route: 7-day windows advancing by 1 day, grace 1 day.
* ST3 z-score alerts: stream-static join with the per-route baseline (mean, std)
  computed in batch; |z| > 3 flags.
* ST4 ledger alerts: stateless filter for negative balances and mismatches.

``base`` names a folder of a run; given again, the stream goes on where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import checkpoint_dir
from larder.sources.tables import read_table, table_path

c = F.col


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A file stream over ``<sf_dir>/<name>.parquet`` with the batch schema."""
    schema, path = read_table(spark, sf_dir, name).schema, table_path(sf_dir, name)
    stream = spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.load(path)
    # A stream reads folders: the one file is picked out of its folder.
    return stream.option("pathGlobFilter", f"{name}.parquet").load(sf_dir)


def run_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def run_to_table(spark: SparkSession, df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) and return the sink table."""
    base = base or run_folder(spark, name)
    out = os.path.join(base, "out")
    q = (df.writeStream.format("parquet").outputMode("append").option("path", out)
           .option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_partial_sums(spark: SparkSession, df: DataFrame, keys: list[str], value: str, ts: str, name: str, base: str | None = None) -> DataFrame:
    """keys, total, n (of ``value``), rows and newest event: sums of the batches' partial sums."""
    base = base or run_folder(spark, name)
    out = os.path.join(base, "out")

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("n"), F.max(ts).alias("newest"))

    def write(rows: DataFrame, batch: int) -> None:
        partial(rows).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(base, "checkpoint"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = partial(df).schema.add("batch", "long")
    parts = spark.read.schema(schema).parquet(out) if q.lastProgress or _exists(spark, out) else spark.createDataFrame([], schema)
    return parts.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("newest").alias("newest"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _complete(sums: DataFrame, grace: str) -> DataFrame:
    """Windows that end at least ``grace`` before the newest event (one row, broadcast)."""
    newest = sums.agg(F.max("newest").alias("_newest"))
    return (sums.join(F.broadcast(newest), c("window.end") <= c("_newest") - F.expr(f"INTERVAL {grace}"))
            .withColumns({"window_start": c("window.start"), "window_end": c("window.end")}))


def sensor_hourly_stream(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST1."""
    from larder.sources.fixtures import fx_sensors
    s = fx_sensors(spark, sf_dir, events=table_stream(spark, sf_dir, "events")).where(c("timestamp").isNotNull())
    s = s.select(F.window("timestamp", "1 hour").alias("window"), "timestamp", "metric_name", "metric_value")
    sums = run_partial_sums(spark, s, ["window", "metric_name"], "metric_value", "timestamp", "st1", base)
    return _complete(sums, "1 HOUR").select("window_start", "window_end", "metric_name",
                                            F.try_divide("total", "n").alias("mean_value"), c("n").alias("readings"))


def delay_rolling_stream(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST2."""
    from larder.functions.derive import dispatch_delay
    from larder.sources.fixtures import fx_dispatch
    d = fx_dispatch(spark, sf_dir, events=table_stream(spark, sf_dir, "events"))
    d = d.where(c("timestamp").isNotNull() & c("route_id").isNotNull()).withColumn("delay", dispatch_delay())
    d = d.select(F.window("timestamp", "7 days", "1 day").alias("window"), "timestamp", "route_id", "delay")
    sums = run_partial_sums(spark, d, ["window", "route_id"], "delay", "timestamp", "st2", base)
    return _complete(sums, "1 DAY").select("window_start", "window_end", "route_id",
                                           F.try_divide("total", "n").alias("mean_delay"), c("n").alias("trips"))


def zscore_alert_stream(spark: SparkSession, sf_dir: str, threshold: float = 3.0, base: str | None = None) -> DataFrame:
    """ST3: streaming rows joined with a static per-route baseline."""
    from larder.functions.derive import dispatch_delay
    from larder.sources.fixtures import fx_dispatch
    past = fx_dispatch(spark, sf_dir).withColumn("delay", dispatch_delay())
    stats = (past.where(c("route_id").isNotNull()).groupBy("route_id")
                 .agg(F.avg("delay").alias("route_mean"), F.stddev_samp("delay").alias("route_std")))
    s = fx_dispatch(spark, sf_dir, events=table_stream(spark, sf_dir, "events")).withColumn("delay", dispatch_delay())
    j = s.join(stats, "route_id")
    z = (c("delay") - c("route_mean")) / F.nullif(c("route_std"), F.lit(0.0))
    alerts = j.withColumn("zscore", z).where(F.abs(c("zscore")) > threshold)
    return run_to_table(spark, alerts.select("dispatch_id", "route_id", "timestamp", "delay", "zscore"), "st3", base)


def ledger_alert_stream(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """ST4: stateless filter on negative balances and ledger mismatches."""
    from larder.sources.fixtures import fx_inventory
    inv = fx_inventory(spark, sf_dir, lineitem=table_stream(spark, sf_dir, "lineitem"))
    calc = c("balance_before") + c("qty_in") - c("qty_out")
    alerts = inv.where((c("balance_after") < 0) | ~c("balance_after").eqNullSafe(calc)).select(
        "record_id", "timestamp", "sku", "movement_type", "balance_after",
        (c("balance_after") < 0).alias("negative_balance"), (~c("balance_after").eqNullSafe(calc)).alias("mismatch"))
    return run_to_table(spark, alerts, "st4", base)
