"""Repeatable samples by row hash (S11), whole and per stratum.

A row's place is the hash of the seed and its id, so a sample of k is the k rows of least hash:
the same whatever the order and the partitions of the rows. The whole sample is Spark's
own bounded top-k of each partition, merged. For strata, counts tell a hash below which each
stratum has its k rows almost surely and few more; those are ranked, and a stratum that
has too few below its mark is taken whole, so that the sample is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.stages import if_small, written

c = F.col

HASH = "_place"
SPAN = 16 ** 8


def place(ids: list[str], seed: int) -> Column:
    """32 hexadecimal digits, spread evenly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c(x).cast("string"), F.lit("")) for x in ids]))


def sample(df: DataFrame, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows of least hash; ids tell rows apart."""
    return df.withColumn(HASH, place(ids, seed)).orderBy(HASH, *ids).limit(k).drop(HASH)


def stratified_sample(df: DataFrame, stratum: str, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows of least hash of each value of ``stratum`` (a null is one too)."""
    rows = df.withColumn(HASH, place(ids, seed))
    key = c(stratum).eqNullSafe(c("_s"))
    share = F.least(F.lit(1.0), F.lit(k + 8 * math.sqrt(k) + 32) / c("_n"))
    marks = df.groupBy(c(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_mark", F.ceil(share * SPAN).cast("long"))
    marks = written(marks, "marks")
    first = F.conv(F.substring(HASH, 1, 8), 16, 10).cast("long")
    low = rows.join(if_small(marks), key).where(first < c("_mark"))
    # A stratum with fewer rows below its mark than it should give: all of its rows count.
    short = written(marks.join(low.groupBy(c(stratum).alias("_l")).agg(F.count(F.lit(1)).alias("_got")), c("_s").eqNullSafe(c("_l")), "left")
                    .where(F.coalesce("_got", F.lit(0)) < F.least(F.lit(k), "_n")).select("_s"), "short-strata")
    low = low.drop("_s", "_n", "_mark")
    if not short.isEmpty():
        low = low.join(if_small(short), key, "left_anti").unionByName(rows.join(if_small(short), key, "left_semi"))
    order = Window.partitionBy(stratum).orderBy(HASH, *ids)
    return low.withColumn("_rank", F.row_number().over(order)).where(c("_rank") <= k).drop("_rank", HASH)
