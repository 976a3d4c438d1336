"""Minimax contiguous partition of ordered atomic groups, in DataFrame functions only.

Rows with equal texts form a group that stays whole. Groups are ordered by their smallest
doc_id (then by their hash). The capacity of a shard is the smallest C for which cutting
greedily (a shard takes groups while their sizes fit in C) needs at most ``shards`` shards;
shards are then cut there.

The search runs on the driver over a bounded table of running sums: every group where
there are few, else the first and last end in each of a fixed number of stretches. From a coarse table follow
a capacity that surely fits and one below which none fits, and for each cut the stretch
of running sums it must lie in; only those stretches are read again, finer, until every
group in them is seen. So the result is exact, and what the driver holds is bounded.

Defined results: a null text has size 8 and counts as an empty text; repeated rows each get
their slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import saved

BUCKET = 4096   # doc_ids that are numbered in one window


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """``ends``: running sums after each group. The running sum at which each shard
    ends, or None if ``shards`` shards of ``capacity`` don't take them all."""
    cuts, at = [], 0
    while at < ends[-1]:
        if len(cuts) == shards:
            return None
        i = bisect_right(ends, at + capacity)
        if i == 0 or ends[i - 1] <= at:
            return None
        at = ends[i - 1]
        cuts.append(at)
    return cuts


def smallest_capacity(ends: list[int], low: int, high: int, shards: int) -> int:
    """The smallest feasible capacity in [low, high]; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _windows(known: list[int], loose: list[tuple[int, int]], low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """For each shard, bounds of its end under any capacity in [low, high].

    ``loose``: stretches between two known ends in which more ends lie, not known yet. A
    place outside them has an exact last end before it.
    """
    starts, out, a, b = [s for s, _ in loose], [], 0, 0

    def last(x: int, up: bool) -> int:
        k = bisect_right(starts, x) - 1
        if up and k >= 0 and loose[k][0] <= x < loose[k][1]:
            return x
        i = bisect_right(known, x)
        return known[i - 1] if i else 0

    for _ in range(shards):
        a, b = last(a + low, False), last(min(b + high, known[-1]), True)
        out.append((a, b))
        if a >= known[-1]:
            break
    return out


def _hit(loose: list[tuple[int, int]], windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(s, e) for s, e in loose if any(a < e and s < b for a, b in windows)]


def minimax_cuts(lookup: Callable[[list[tuple[int, int]], int], list[tuple[int, int, int]]], total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """Capacity and ends of the shards.

    ``lookup(ranges, width)`` gives (first end, last end, number of ends) of each stretch of
    ``width`` that has ends inside the ``ranges`` (start excluded). Each round looks closer at
    the stretches that cuts may fall into. A capacity that does when cutting at known ends
    is at most the longest such stretch above the best, which narrows the bounds.
    """
    low, high = max(largest, -(-total // shards)), total
    known, loose, todo = [0, total], [(0, total)], [(0, total)]
    while todo:
        width = max(1, sum(e - s for s, e in todo) // (16 * shards * (shards + 1)))
        rows = lookup(todo, width)
        known = sorted({*known, *(a for a, _, _ in rows), *(b for _, b, _ in rows)})
        loose = _joined(sorted({*loose} - {*todo} | {(a, b) for a, b, n in rows if n > 2}), apart=0)
        high = smallest_capacity(known, low, high, shards)
        todo = _hit(loose, _windows(known, loose, low, high, shards))
        if todo:
            low = max(low, high - max(e - s for s, e in todo))
            todo = _hit(loose, _windows(known, loose, low, high, shards))
    high = smallest_capacity(known, low, high, shards)
    return high, greedy_cuts(known, high, shards)


def _joined(ranges: list[tuple[int, int]], apart: int = 1) -> list[tuple[int, int]]:
    """Sorted ranges, joined where they overlap (or less than ``apart`` lies between them)."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a - out[-1][1] < apart:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _lookup(sums: DataFrame):
    """Ends in ``sums.sum_end``. The ranges are widened over small gaps to at most 32, so
    that the filter stays short; the Parquet reader skips row groups by it."""
    end = F.col("sum_end")

    def run(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
        wide = _joined(sorted(ranges))
        gaps = sorted(((b[0] - a[1], i) for i, (a, b) in enumerate(zip(wide, wide[1:]))), reverse=True)[:31]
        at = [0, *(i + 1 for i in sorted(i for _, i in gaps)), len(wide)]
        inside = F.lit(False)
        for i, j in zip(at, at[1:]):
            inside = inside | ((end > wide[i][0]) & (end <= wide[j - 1][1]))
        rows = sums.filter(inside).groupBy(F.floor(end / width).alias("w")).agg(F.min("sum_end").alias("a"), F.max("sum_end").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return [(r["a"], r["b"], r["n"]) for r in rows]
    return run


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_first of every row."""
    c = F.col
    text = F.coalesce("text", F.lit("")).cast("binary")
    d = saved(docs.select(c("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                          F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")), "shard-rows")
    bucket = F.floor(F.coalesce("doc_id", F.lit(0)) / BUCKET)
    # Rows of a group before each of its buckets of ids, so that no window holds a whole large group.
    parts = d.groupBy("g", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("doc_id").alias("first"))
    parts = saved(parts, "shard-parts")
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("first").alias("first"))
    # Running sums: within ranges of the order, then over the ranges (one row a range).
    ordered = saved(groups.repartitionByRange(c("first").asc_nulls_first(), "g")
                    .withColumn("part", F.spark_partition_id()), "shard-groups")
    w = Window.partitionBy("part").orderBy(c("first").asc_nulls_first(), "g").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (ordered.groupBy("part").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
             .select(c("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_base")))
    sums = saved(ordered.withColumn("s", F.sum("size").over(w)).withColumn("k", F.sum("n").over(w)).join(bases, c("part") == c("p"))
                 .select("g", "first", "size", (c("size_base") + c("s")).alias("sum_end"), (c("n_base") + c("k") - c("n")).alias("rows_before")), "shard-sums")
    total, largest = sums.agg(F.max("sum_end"), F.max("size")).first()
    if not total:
        cuts = []
    else:
        _, cuts = minimax_cuts(_lookup(sums), int(total), int(largest), shards)
    shard = F.lit(0)
    for e in cuts[:-1]:  # at most 23 comparisons
        shard = shard + (c("sum_end") > e).cast("int")
    sums = sums.withColumn("shard", shard)
    firsts = sums.groupBy("shard").agg(F.min("rows_before").alias("shard_rows"))
    sums = sums.join(F.broadcast(firsts), "shard")  # one row a shard
    pw = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "bucket", F.coalesce(F.sum("n").over(pw), F.lit(0)).alias("in_group"))
    places = parts.join(sums.select(c("g").alias("g2"), "first", "shard", (c("rows_before") - c("shard_rows")).alias("base")), c("g") == c("g2")).drop("g2")
    rw = Window.partitionBy("g", "bucket").orderBy("doc_id")
    rows = d.withColumn("bucket", bucket).withColumn("i", F.row_number().over(rw) - 1)
    return (rows.join(places.select(c("g").alias("g2"), c("bucket").alias("b2"), "in_group", "first", "shard", "base"), (c("g") == c("g2")) & (c("bucket") == c("b2")))
            .select("doc_id", "size", "text_crc32", "shard", (c("base") + c("in_group") + c("i")).cast("long").alias("slot"), c("first").alias("group_first")))
