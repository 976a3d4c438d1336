"""Content fingerprints of tables (S14): the key under which derived results are kept.

Each cell is hashed together with its column's name, each row over all of its columns; the
hashes are summed, with their number and that of the nulls. Sums do not depend on the order
of rows or on partitions, a changed, added or removed cell changes them, and cells that change
places between rows change the row sum. One pass, one row a column.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
ROW = "*"


def column_fingerprints(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_nulls, hash_sum of each column, and of whole rows under ``*``."""
    def hashed(*cells):
        return F.xxhash64(*cells).cast("decimal(38, 0)")

    # hash functions pass over nulls, so each cell says whether it is one.
    cells = {x: (F.lit(x), F.col(f"`{x}`").isNull(), F.col(f"`{x}`")) for x in df.columns}
    whole = [y for x in sorted(cells) for y in cells[x]]
    aggs = [F.struct(F.lit(x).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(null).alias("n_nulls"), F.coalesce(F.sum(hashed(name, null, value)), F.lit(0).cast("decimal(38, 0)")).alias("hash_sum"))
            for x, (name, null, value) in cells.items()]
    aggs.append(F.struct(F.lit(ROW).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("long").alias("n_nulls"),
                         F.coalesce(F.sum(hashed(*whole)), F.lit(0).cast("decimal(38, 0)")).alias("hash_sum")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def fingerprint(df: DataFrame) -> str:
    """One text for the content of ``df``: its columns, their types and their fingerprints, one row a column."""
    rows = sorted((r["column_name"], r["n_rows"], r["n_nulls"], str(r["hash_sum"])) for r in column_fingerprints(df).collect())
    types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(repr((types, rows)).encode()).hexdigest()


def column_totals(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_nulls, total (of numbers; null for others): what a reader can check by hand."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    aggs = [F.struct(F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c(f"`{f.name}`").isNull()).alias("n_nulls"),
                     (F.round(F.coalesce(F.sum(c(f"`{f.name}`").cast("double")), F.lit(0.0)), 2) if f.dataType.simpleString() in numeric else F.lit(None).cast("double")).alias("total"))
            for f in df.schema.fields]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
