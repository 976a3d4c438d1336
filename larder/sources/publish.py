"""One-file CSV and JSON reports (S08, S10), and larger exports.

A report is an aggregate of bounded size: it is written by one task into a folder of its own,
and the file gets its name by a rename once it is whole. A frame of more than ``MAX_ROWS`` rows
is no report and is refused before it reaches one task; exports of any size are folders of files
with a ``_SUCCESS`` mark.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 1_000_000
JSON = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "lineSep": "\n"}
CSV = {"header": "true", "nullValue": "", "emptyValue": '""', "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "lineSep": "\n"}


class TooLarge(ValueError):
    """More rows than a report may have."""


def _one_file(df: DataFrame, path: str, kind: str, options: dict[str, str], max_rows: int, order: list[str]) -> str:
    from larder.operators.stages import written

    spark = df.sparkSession
    df = written(df, "report")  # counted and written from the same rows
    rows = df.count()
    if rows > max_rows:
        raise TooLarge(f"{rows} rows; a report has at most {max_rows}")
    draft = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    # At most max_rows rows go to one task, in order.
    df.coalesce(1).sortWithinPartitions(*(order or df.columns)).write.options(**options).format(kind).save(draft)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(Path(draft)) if s.getPath().getName().startswith("part-")]
    if not parts:  # no rows: a file with the header alone, or an empty one
        out = fs.create(Path(f"{draft}/part-0"), True)
        out.write(bytearray((",".join(df.columns) + "\n" if kind == "csv" else "").encode()))
        out.close()
        parts = [Path(f"{draft}/part-0")]
    if fs.exists(Path(path)):
        fs.delete(Path(path), False)
    if not fs.rename(parts[0], Path(path)):
        raise OSError(f"could not name {path}")
    fs.delete(Path(draft), True)
    return path


def publish_csv(df: DataFrame, path: str, max_rows: int = MAX_ROWS, order: list[str] | None = None) -> str:
    """``df`` as one CSV file with a header, rows in the order of ``order`` (else of all columns)."""
    return _one_file(df, path, "csv", CSV, max_rows, order or [])


def publish_json(df: DataFrame, path: str, max_rows: int = MAX_ROWS, order: list[str] | None = None) -> str:
    """``df`` as one file of JSON lines; nulls are written."""
    return _one_file(df, path, "json", JSON, max_rows, order or [])


def export_csv(df: DataFrame, path: str) -> str:
    """``df``, of any size, as a folder of CSV files with headers."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path


def read_report(spark: SparkSession, path: str, schema, kind: str = "csv") -> DataFrame:
    # What the reader puts in for nothing, and for two quotes, has to differ.
    options = CSV | {"nullValue": "\\N", "emptyValue": ""} if kind == "csv" else JSON
    return spark.read.schema(schema).options(**options).format(kind).load(path)
