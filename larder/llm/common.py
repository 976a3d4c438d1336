"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, and what a lost executor held is read again from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HOLDER: list = []


def hold_alone(name: str, forget: Callable[[], None]) -> None:
    """Called at the start of a task of an operator that remembers things between tasks:
    what another operator left in this Python worker is forgotten, and its memory given back."""
    if _HOLDER and _HOLDER[0] != name:
        _HOLDER[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _HOLDER[:] = [name, forget]


BROADCAST_ROWS = 200_000  # of a few numbers each: at most some MB


def sided(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, a written one of narrow rows, marked for broadcast if it has at most
    ``rows`` rows (counted from the files' metadata); else as it is, for a shuffle join."""
    return F.broadcast(table) if table.count() <= rows else table


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
