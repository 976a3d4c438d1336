"""Windowed stream jobs with a watermark and state (ST1, ST2).

A window's sums live in the state store until the watermark, the newest event less the grace
period, passes its end. Then the window is appended to the sink once, and its state is
dropped, so the state holds the open windows alone, however long the stream runs. A row whose
window has been closed is late: Spark leaves it out. Late rows are counted, by what was
read less what was appended and what is still open in the state store.

A run that stops, in the middle or by a failure, goes on from its checkpoint when it is
started again with the same ``base``: offsets, state and watermark are all there, and a
batch that was half written is written anew.

* ``sensor_hourly`` (ST1): hourly sensor means, grace 1 hour.
* ``delay_rolling`` (ST2): delay per route over 7 days, every day, grace 1 day.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.derive import dispatch_delay
from larder.sources.fixtures import fx_dispatch, fx_sensors
from larder.streaming import streams

c = F.col


def _epoch():
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))


def _instant(ts):
    """A watermark wants a point in time; the tables hold clock times, taken as UTC."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), ts))


def _clock(ts):
    """Windows begin and end at whole hours."""
    return F.timestamp_add("HOUR", F.floor(F.unix_seconds(ts) / 3600).cast("int"), _epoch())


@dataclass(frozen=True)
class WindowJob:
    """Sums of ``value`` by window and key, over rows that ``prepare`` makes from the events table."""
    name: str
    prepare: object
    keys: tuple[str, ...]
    value: str
    length: str
    every: str
    grace: str

    def windows(self, rows: DataFrame) -> DataFrame:
        window = F.window("timestamp", self.length, self.every)
        return rows.groupBy(window.alias("window"), *self.keys).agg(
            F.sum(self.value).cast("double").alias("total"), F.count(self.value).alias("n"), F.count(F.lit(1)).alias("rows"))

    def start(self, spark: SparkSession, sf_dir: str, base: str, files_per_batch: int = 64, **trigger) -> StreamingQuery:
        """The running query. Without a trigger it stops when the files there are have been read."""
        events = streams.table_stream(spark, sf_dir, "events", files_per_batch)
        rows = self.prepare(spark, sf_dir, events).withWatermark("timestamp", self.grace)
        return (self.windows(rows).writeStream.format("parquet").outputMode("append").queryName(f"{self.name}-{os.path.basename(base)}")
                .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "checkpoint"))
                .trigger(**(trigger or {"availableNow": True})).start())

    def run(self, spark: SparkSession, sf_dir: str, base: str | None = None, files_per_batch: int = 64) -> DataFrame:
        """Read all files there are; the windows closed so far."""
        base = base or streams.run_folder(spark, self.name)
        self.start(spark, sf_dir, base, files_per_batch).awaitTermination()
        return self.closed(spark, sf_dir, base)

    def closed(self, spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
        schema = self.windows(self.prepare(spark, sf_dir, None)).schema
        out = os.path.join(base, "out")
        rows = spark.read.schema(schema).parquet(out) if streams._exists(spark, out) else spark.createDataFrame([], schema)
        return rows.select(_clock(c("window.start")).alias("window_start"), _clock(c("window.end")).alias("window_end"), *self.keys,
                           F.try_divide("total", "n").alias("mean"), "n", "rows")

    def open_rows(self, spark: SparkSession, base: str) -> int:
        """Rows, once for each window that they lie in, of the windows still in the state store."""
        state = spark.read.format("statestore").load(os.path.join(base, "checkpoint"))
        # The buffers of the aggregates, in their order; two of them have the same name.
        kinds = [f.dataType.simpleString() for f in state.schema["value"].dataType.fields]
        value = c("value").cast("struct<" + ",".join(f"c{i}:{k}" for i, k in enumerate(kinds)) + ">")
        return state.agg(F.coalesce(F.sum(value[f"c{len(kinds) - 1}"]), F.lit(0))).first()[0]

    def late_rows(self, spark: SparkSession, sf_dir: str, base: str) -> int:
        """Rows, once for each window, that came after their window was closed. For a run that has
        read all files there are."""
        read = self.windows(self.prepare(spark, sf_dir, None)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        done = self.closed(spark, sf_dir, base).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return read - done - self.open_rows(spark, base)


def _readings(spark, sf_dir, events):
    return (fx_sensors(spark, sf_dir, events=events).where(c("timestamp").isNotNull())
            .select(_instant(c("timestamp")).alias("timestamp"), "metric_name", "metric_value"))


def _delays(spark, sf_dir, events):
    rows = fx_dispatch(spark, sf_dir, events=events).withColumn("delay", dispatch_delay())
    return rows.where(c("timestamp").isNotNull() & c("route_id").isNotNull()).select(_instant(c("timestamp")).alias("timestamp"), "route_id", "delay")


sensor_hourly = WindowJob("st1", _readings, ("metric_name",), "metric_value", "1 hour", "1 hour", "1 hour")
delay_rolling = WindowJob("st2", _delays, ("route_id",), "delay", "7 days", "1 day", "1 day")
