"""Column profiles: missing counts (A10), schema profile (C09), describe-all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL count per column, only columns with at least one NULL.

    One pass: a single wide aggregate of ``count_if(col IS NULL)``, then
    unpivoted to (column, missing) rows.
    """
    cols = df.columns
    wide = df.agg(*[F.count_if(c(x).isNull()).alias(x) for x in cols])
    long = wide.unpivot([], cols, "column", "missing")
    return long.where(c("missing") > 0)


def schema_profile(df: DataFrame, examples: int = 3) -> DataFrame:
    """Per column: type, NULL count and %, up to ``examples`` distinct sample
    values (the smallest, as strings) and the row count (C09).

    NULL counts are one wide aggregate. Examples come from a distinct
    (column, value) projection ranked per column, so only one row per
    distinct value and column is shuffled and no column is collected whole.
    """
    from pyspark.sql import Window

    cols = df.columns
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(c(x).isNull()).alias(x) for x in cols])
    nulls = wide.unpivot(["__rows"], cols, "column", "nulls")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("v")) for x in cols])).alias("kv"))
    vals = long.select("kv.column", "kv.v").where(c("v").isNotNull()).distinct()
    ranked = vals.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("v")))
    ex = (ranked.where(c("_r") <= examples).groupBy("column")
                .agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("examples")))
    spark = df.sparkSession
    t = spark.createDataFrame([(k, v) for k, v in types.items()], "column string, dtype string")
    return (t.join(nulls, "column").join(ex, "column", "left")
             .select("column", "dtype", "nulls",
                     F.round(F.try_divide(c("nulls") * 100.0, c("__rows")), 6).alias("null_pct"),
                     "examples", c("__rows").alias("rows")))
