"""As-of join (P03): each left row with the last right row of its key at or before its time.

Time is cut into blocks. Both sides are laid out by (key, block), so a key that holds a third of the
rows is spread over as many tasks as its history has blocks, and inside a block a running
``last`` finds the match in one sorted pass. What a block inherits, the last right row of the blocks before
it, however many of those are empty, comes from a scan in two levels over one row a block:
first over spans of ``SPAN`` blocks, then over the blocks inside a span. No rows are
compared pairwise, and no window covers all rows of a key.

The length of a block follows the data: one count by key and day, and blocks as short as the
fullest day needs to hold about ``BLOCK_ROWS`` rows.

Right rows of one key and time are ranked by ``tie``; the largest wins. Left rows without a key
or a time match nothing; right rows without are never matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col

SPAN = 1024
BLOCK_ROWS = 500_000
DAY = 86_400_000_000


def micros(ts):
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def block_length(rows: DataFrame, keys: list[str], at: str, block_rows: int = BLOCK_ROWS) -> int:
    """Microseconds of a block such that the fullest key and day, spread evenly, fills ``block_rows``."""
    day = rows.groupBy(*keys, F.floor(c(at) / DAY).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    most = day.agg(F.max("_n")).first()[0] or 0
    return max(1_000_000, DAY // max(1, -(-most // block_rows)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str,
              columns: list[str], tolerance_seconds: int | None = None, block_micros: int | None = None) -> DataFrame:
    """``left`` with the ``columns`` of the matched right row, null where there is none.

    ``keys`` name the same columns on both sides. With ``tolerance_seconds``, right rows that
    are older do not match.
    """
    clash = [x for x in columns if x in left.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    found = F.struct(micros(c(right_ts)).alias("_seen"), c(tie).alias("_tie"), *columns)
    whole = c(left_ts).isNotNull()
    for k in keys:
        whole = whole & c(k).isNotNull()
    l = left.withColumns({"_at": micros(c(left_ts)), "_row": F.struct(*left.columns), "_found": F.lit(None).cast(right.select(found.alias("f")).schema[0].dataType)})
    r = right.where(c(right_ts).isNotNull())
    for k in keys:
        r = r.where(c(k).isNotNull())
    r = r.withColumns({"_at": micros(c(right_ts)), "_row": F.lit(None).cast(l.schema["_row"].dataType), "_found": found})
    parts = [*keys, "_at", "_row", "_found"]
    both = l.where(whole).select(*parts).unionByName(r.select(*parts))
    size = block_micros or block_length(both, keys, "_at")
    both = both.withColumn("_block", F.floor(c("_at") / size))

    # One row a block: its last right row. Then spans, then blocks inside their span.
    blocks = both.groupBy(*keys, "_block").agg(F.max("_found").alias("_last")).withColumn("_span", F.floor(c("_block") / SPAN))
    spans = blocks.groupBy(*keys, "_span").agg(F.max("_last").alias("_span_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_span_before", F.max("_span_last").over(before)).drop("_span_last")
    before = Window.partitionBy(*keys, "_span").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (blocks.withColumn("_block_before", F.max("_last").over(before)).join(spans, [*keys, "_span"])
               .select(*keys, "_block", F.coalesce("_block_before", "_span_before").alias("_before")))

    # Right rows sort before left rows of the same time (a null row sorts first).
    own = Window.partitionBy(*keys, "_block").orderBy("_at", c("_row").isNotNull(), "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_own", F.last("_found", ignorenulls=True).over(own)).where(c("_row").isNotNull())
    rows = rows.join(carried, [*keys, "_block"], "left").withColumn("_hit", F.coalesce("_own", "_before"))
    if tolerance_seconds is not None:
        rows = rows.withColumn("_hit", F.when(c("_at") - c("_hit._seen") <= tolerance_seconds * 1_000_000, c("_hit")))
    out = rows.select("_row.*", *[c(f"_hit.{x}").alias(x) for x in columns])
    none = [F.lit(None).cast(right.schema[x].dataType).alias(x) for x in columns]
    return out.unionByName(left.where(~whole).select(*left.columns, *none))
