"""Tables written between the steps of a job, and joins whose strategy depends on a measured size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import scratch_path

SMALL_ROWS = 100_000  # of a few numbers or names each: some MB


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what a lost executor held is read again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table
