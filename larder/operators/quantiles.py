"""Exact quantiles of any number of rows per key.

Spark's ``percentile`` keeps all distinct values of a key in one buffer, so a key with a third
of the rows fills one task. Here keys of up to ``LIMIT`` values go that way. For larger ones the
ranks asked for are found in rounds: a histogram of ``BINS`` bins over the interval that a rank is known to
lie in, with the least and greatest value of each bin; the counts tell the bin, and its values
make the next, narrower interval. Once an interval holds at most ``LIMIT`` values, or one value
alone, its distinct values are counted and sorted. Each shuffle carries a bounded number of
rows a key: bins, or the distinct values of such an interval.

A quantile p of n values interpolates linearly between the values of rank floor and
ceiling of p * (n - 1), as ``percentile`` does. Nulls and NaN take no part; rows with a null
key are left out, like everywhere in the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import stages
from larder.operators.stages import if_small, written

c = F.col

LIMIT = 100_000
BINS = 4096
_GREATEST = 1.7976931348623157e308


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """Number of the bin of ``x`` in [lo, hi]; rises with x. Halves keep the width finite, infinities
    lie in the outermost bins."""
    def half(v):
        return F.greatest(F.lit(-_GREATEST), F.least(F.lit(_GREATEST), v)) / 2
    width = half(hi) - half(lo)
    return F.when(width > 0, F.least(F.floor((half(x) - half(lo)) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _narrow(base: DataFrame, keys: list[str], open_: DataFrame) -> DataFrame:
    """One round: for each (key, rank) with its interval lo..hi above ``below`` values, the bin that
    holds the rank."""
    spans = written(open_.select(*keys, "lo", "hi").distinct(), "intervals")
    rows = base.join(if_small(spans), keys).where(c("_x").between(c("lo"), c("hi")))
    bins = (rows.groupBy(*keys, "lo", _bin(c("_x"), c("lo"), c("hi")).alias("bin"))
            .agg(F.count(F.lit(1)).alias("size"), F.min("_x").alias("new_lo"), F.max("_x").alias("new_hi")))
    upto = Window.partitionBy(*keys, "lo").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("size").over(upto))
    hit = (c("rank") - c("below") >= c("upto") - c("size")) & (c("rank") - c("below") < c("upto"))
    return (open_.drop("size").join(bins, [*keys, "lo"]).where(hit)
            .select(*keys, "rank", (c("below") + c("upto") - c("size")).alias("below"), c("new_lo").alias("lo"), c("new_hi").alias("hi"), "size"))


def _finish(base: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """The value of each (key, rank) whose interval holds few distinct values."""
    spans = written(found.select(*keys, "lo", "hi").distinct(), "intervals")
    rows = base.join(if_small(spans), keys).where(c("_x").between(c("lo"), c("hi")))
    values = rows.groupBy(*keys, "lo", "_x").agg(F.count(F.lit(1)).alias("times"))
    upto = Window.partitionBy(*keys, "lo").orderBy("_x")
    values = values.withColumn("upto", F.sum("times").over(upto))
    hit = (c("rank") - c("below") >= c("upto") - c("times")) & (c("rank") - c("below") < c("upto"))
    return found.join(values, [*keys, "lo"]).where(hit).select(*keys, "rank", "_x")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], limit: int | None = None,
                    stored: bool = False) -> DataFrame:
    """keys, n (values that count) and one column for each of ``probs``. Without keys: one row, if
    there is any value. Keys and values are written once and each pass reads them, unless ``df`` is
    ``stored`` already."""
    limit = limit or LIMIT
    x = c(value).cast("double")
    base = df.where(x.isNotNull() & ~F.isnan(x))
    for k in keys:
        base = base.where(c(k).isNotNull())
    base = base.select(*keys, x.alias("_x"))
    by = keys
    if not keys:
        base, by = base.withColumn("_all", F.lit(0)), ["_all"]
    if not stored:
        base = stages.written(base, "quantile-values")
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    big = written(sizes.where(c("n") > limit), "large-keys")
    small = base if big.isEmpty() else base.join(if_small(big.select(*by)), by, "left_anti")
    quantiles = F.percentile("_x", F.array(*map(F.lit, probs)))
    out = small.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), quantiles.alias("_q"))
    out = out.select(*by, "n", *[c("_q")[i].alias(name) for i, name in enumerate(names)])
    if not big.isEmpty():
        place = [F.lit(p) * (c("n") - 1) for p in probs]
        ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q), F.ceil(q)) for q in place])))
        open_ = big.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", c("n").alias("size"))
        base = base.join(if_small(big.select(*by)), by, "left_semi")
        done = None
        while not open_.isEmpty():
            step = written(_narrow(base, by, open_), "ranks")
            few = (c("size") <= limit) | (_bin(c("hi"), c("lo"), c("hi")) == 0)  # or one value, or the outermost ones
            done = step.where(few) if done is None else done.unionByName(step.where(few))
            open_ = step.where(~few)
        at = written(_finish(base, by, done), "ranked")
        cols = [*[c(k) for k in by], c("n")]
        found = big.select(*by, "n").join(at.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("at")), by)
        for q, name in zip(place, names):
            low, high = F.element_at("at", F.floor(q)), F.element_at("at", F.ceil(q))
            cols.append(F.when(F.floor(q) == F.ceil(q), low).otherwise((F.ceil(q) - q) * low + (q - F.floor(q)) * high).alias(name))
        out = out.unionByName(found.select(*cols))
    return out.drop("_all")


def add_quantiles(grouped: DataFrame, rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], stored: bool = False) -> DataFrame:
    """``grouped``, one row a key (or one row), with the quantiles of ``rows`` by name, rounded like every report."""
    q = exact_quantiles(rows, keys, value, list(wanted.values()), list(wanted), stored=stored)
    q = q.select(*keys, *[F.round(x, 6).alias(x) for x in wanted])
    return grouped.join(q, keys, "left") if keys else grouped.join(F.broadcast(q), F.lit(True), "left")
