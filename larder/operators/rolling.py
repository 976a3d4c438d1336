"""Skew-proof trailing time-window statistics (W01, scale form).

A plain ``OVER (PARTITION BY key ORDER BY ts RANGE ...)`` window puts every
row of a key into one task, and Spark's sliding frame re-aggregates an exact
``percentile`` for every row (O(rows x frame)). With two plants holding half
the rows each, that is two giant tasks.

Here only (key, time, value) take part; the statistics of each key and time are joined back to the rows.
A key's time line is cut into slices of a window's m-th part, m a power of two chosen by key so that the
fullest slice holds about ``SLICE_ROWS`` rows. The windows of a slice's rows hold parts of two slices, its own and the
m-th before, whose rows are sent to it, and the slices between as a whole (the core). Of the core a
task gets the moments and, for the median, only the values that can be it: those whose rank
among the core's is nearer to the middle than half the rows of the two outer slices. Which
these are is told by a histogram by slice and value bin; values below them are a number. So a task holds
a few times ``SLICE_ROWS`` rows however many a window has. Rows of one time can't be cut.

Statistics per row over (ts - W, ts]: mean, exact median, sample std (NULL
-> 0) and count; rows with equal timestamps share one frame. Rows whose key
or timestamp is NULL keep NULL statistics and count 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.asof import DAY, micros
from larder.operators.stages import if_small, written

c = F.col

_WINDOW_DAYS = {"7D": 7, "30D": 30}
SLICE_ROWS = 50_000
MAX_SLICES = 8192  # of a window; divides its microseconds
BINS = 1024  # of a key's values
# Kinds of rows that a slice's task gets: rows of its own and of the m-th slice before, values of the core, numbers of the core.
OWN, LEAVING, CORE, BELOW, CORE_N, MEAN, M2, LEAST, MOST = range(9)


def stat_names(prefix: str, window: str) -> list[str]:
    return [f"{prefix}_mean_{window}", f"{prefix}_median_{window}",
            f"{prefix}_std_{window}", f"{prefix}_count_{window}"]


def _whole(x, y):
    """floor(x / y) of whole numbers, exactly: the difference divides, and is far below 2^53 of the quotient."""
    return F.round((x - F.pmod(x, y)) / y).cast("long")


def _slices(times: DataFrame, days: int, slice_rows: int) -> DataFrame:
    """k, m: the slices of a window of each key, by its fullest day."""
    by_day = times.groupBy("k", F.floor(c("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    parts = F.greatest(F.lit(1.0), F.max("rows") * days / slice_rows)
    m = F.least(F.lit(MAX_SLICES), F.pow(F.lit(2.0), F.ceil(F.log2(parts)))).cast("long")
    return by_day.groupBy("k").agg(m.alias("m"))


def _with_bins(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``bin``: how many of the key's edges lie below the value, found by halving; ``x0``: the bin's edge."""
    rows = rows.join(if_small(edges, 1000), "k").withColumn("bin", F.lit(0))
    step = BINS // 2
    while step:
        below = c("v") > F.get("edges", c("bin") + (step - 1))
        rows = rows.withColumn("bin", c("bin") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return rows.withColumn("x0", F.get("edges", F.greatest(c("bin") - 1, F.lit(0)))).drop("edges")


def _needs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each slice of one key: moments of its core, the bins that may hold a median and the values below them."""
    m, first = int(pdf["m"].iloc[0]), int(pdf["j"].min())
    j, b = (pdf["j"] - first).to_numpy("int64"), pdf["bin"].to_numpy("int64")
    own = np.unique(j)
    sizes = np.zeros((own.size, BINS), "int64")
    at = np.searchsorted(own, j)
    np.add.at(sizes, (at, b), pdf["n"].to_numpy("int64"))
    upto = np.vstack([np.zeros((1, BINS), "int64"), sizes.cumsum(axis=0)])
    rows = sizes.sum(axis=1)
    # Sums about an edge near the values, merged as means and squares about them: no large numbers are subtracted.
    n, s1, s2, x0 = (pdf[x].fillna(0.0).to_numpy("float64") for x in ("n", "s1", "s2", "x0"))
    mean = x0 + s1 / np.maximum(n, 1)
    means = np.bincount(at, n * mean, own.size) / np.maximum(rows, 1)
    squares = np.bincount(at, s2 - s1 * s1 / np.maximum(n, 1) + n * (mean - means[at]) ** 2, own.size)
    least, most = np.full(own.size, np.inf), np.full(own.size, -np.inf)
    np.minimum.at(least, at, pdf["lo"].fillna(np.inf).to_numpy("float64"))
    np.maximum.at(most, at, pdf["hi"].fillna(-np.inf).to_numpy("float64"))
    out = []
    for i, slice_ in enumerate(own):
        a = int(np.searchsorted(own, slice_ - m + 1))
        core = upto[i] - upto[a]
        size = int(core.sum())
        if not size:
            continue
        gone = int(np.searchsorted(own, slice_ - m))
        outer = int(rows[i]) + (int(rows[gone]) if gone < own.size and own[gone] == slice_ - m else 0)
        cum = core.cumsum()
        low, high = max(0, (size - outer) // 2 - 2), min(size - 1, (size + outer) // 2 + 2)
        b0, b1 = int(np.searchsorted(cum, low, "right")), int(np.searchsorted(cum, high, "right"))
        middle = (rows[a:i] * means[a:i]).sum() / size
        out.append((pdf["k"].iloc[0], slice_ + first, m, b0, b1, int(cum[b0] - core[b0]), size, middle,
                    max(0.0, (squares[a:i] + rows[a:i] * (means[a:i] - middle) ** 2).sum()), least[a:i].min(), most[a:i].max()))
    return pd.DataFrame(out, columns=["k", "j", "m", "b0", "b1", "below", "size", "mean", "m2", "least", "most"])


def _core(rows: DataFrame, key_type: str) -> DataFrame:
    """What each slice is told of its core, for the keys with more than one slice a window: k, j, kind, t, v, n."""
    known = rows.where(c("v").isNotNull())
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    edges = written(known.groupBy("k").agg(F.percentile_approx("v", probs, 10000).alias("edges")), "value-bins")
    # Rows without a value count for nothing, but their slice is one, too.
    binned = _with_bins(rows, edges).withColumn("n", F.when(c("v").isNotNull(), c("n")).otherwise(F.lit(0)))
    binned = written(binned.groupBy("k", "m", "x0", "j", "bin", "v").agg(F.sum("n").alias("n")), "slice-values")
    u = c("v") - c("x0")
    hist = binned.groupBy("k", "m", "x0", "j", "bin").agg(F.sum("n").alias("n"), F.coalesce(F.sum(c("n") * u), F.lit(0.0)).alias("s1"),
                                                        F.coalesce(F.sum(c("n") * u * u), F.lit(0.0)).alias("s2"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    schema = f"k {key_type}, j long, m long, b0 int, b1 int, below long, size long, mean double, m2 double, least double, most double"
    needs = written(hist.groupBy("k").applyInPandas(_needs, schema), "slice-needs")
    wanted = written(needs.select("k", c("j").alias("to"), F.explode(F.sequence("b0", "b1")).alias("bin")), "slice-bins")
    values = (binned.where(c("v").isNotNull()).join(if_small(wanted), ["k", "bin"]).where((c("j") < c("to")) & (c("to") < c("j") + c("m")))
              .groupBy("k", "to", "v").agg(F.sum("n").alias("n")).select("k", c("to").alias("j"), F.lit(CORE).alias("kind"), F.lit(0).cast("long").alias("t"), "v", "n"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    told = [(BELOW, none, c("below")), (CORE_N, none, c("size")), (MEAN, c("mean"), zero), (M2, c("m2"), zero), (LEAST, c("least"), zero), (MOST, c("most"), zero)]
    numbers = needs.select("k", "j", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), zero.alias("t"), v.alias("v"), n.alias("n")) for kind, v, n in told])).alias("x"))
    return values.unionByName(numbers.select("k", "j", "x.*"))


def _medians(own, leaving, values, starts, below, core_n) -> np.ndarray:
    """Median of each window. ``own`` and ``leaving``: (times, values, counts) by time; ``values``: (values, counts)
    of the core; a place among all values is kept and moved as rows come and go."""
    all_values = np.unique(np.concatenate([own[1], leaving[1], values[0]]))
    u = all_values.tolist()
    counts = np.zeros(len(u) + 1, "int64")
    np.add.at(counts, np.searchsorted(all_values, values[0]), values[1])
    np.add.at(counts, np.searchsorted(all_values, leaving[1]), leaving[2])
    cnt, p, total = counts.tolist(), 0, core_n + int(leaving[2].sum())
    come_at, come, come_n = own[0].tolist(), np.searchsorted(all_values, own[1]).tolist(), own[2].tolist()
    go_at, go, go_n = leaving[0].tolist(), np.searchsorted(all_values, leaving[1]).tolist(), leaving[2].tolist()
    i = g = 0
    out = []
    for t, start in starts:
        while i < len(come_at) and come_at[i] <= t:
            cnt[come[i]] += come_n[i]
            total += come_n[i]
            if come[i] < p:
                below += come_n[i]
            i += 1
        while g < len(go_at) and go_at[g] <= start:
            cnt[go[g]] -= go_n[g]
            total -= go_n[g]
            if go[g] < p:
                below -= go_n[g]
            g += 1
        if not total:
            out.append(float("nan"))
            continue
        r1, r2 = (total - 1) // 2, total // 2
        while below > r1:
            p -= 1
            below -= cnt[p]
        while below + cnt[p] <= r1:
            below += cnt[p]
            p += 1
        q, upto = p, below + cnt[p]
        while upto <= r2:
            q += 1
            upto += cnt[q]
        out.append((u[p] + u[q]) / 2)
    return np.array(out, "float64")


def _window_stats(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """One slice: mean, median, std and count at each of its times."""
    pdf = pdf.sort_values(["kind", "t"], kind="mergesort")
    kind = pdf["kind"].to_numpy()
    t, v, n = pdf["t"].to_numpy("int64"), pdf["v"].to_numpy("float64"), pdf["n"].to_numpy("int64")

    def part(k, filled=True):
        at = (kind == k) & (~np.isnan(v) if filled else True)
        return t[at], v[at], n[at]

    times = np.unique(part(OWN, False)[0])
    own, leaving, core = part(OWN), part(LEAVING), part(CORE)
    told = {k: (v[kind == k][0], int(n[kind == k][0])) for k in range(BELOW, MOST + 1) if (kind == k).any()}
    below, core_n = told[BELOW][1] if told else 0, told[CORE_N][1] if told else 0
    center = told[MEAN][0] if told else float(np.concatenate([own[1], leaving[1], [0.0]])[0])

    def running(x, w):
        """Count, sum and squares about the center, least and most of the first i values."""
        d = x - center
        sums = [np.concatenate([[0.0], np.cumsum(y)]) for y in (w, w * d, w * d * d)]
        return [*sums, np.concatenate([[np.inf], np.minimum.accumulate(x)]) if x.size else np.array([np.inf]),
                np.concatenate([[-np.inf], np.maximum.accumulate(x)]) if x.size else np.array([-np.inf])]

    come = [y[np.searchsorted(own[0], times, "right")] for y in running(own[1], own[2])]
    left = leaving[0].size - np.searchsorted(leaving[0], times - length, "right")
    stay = [y[left] for y in running(leaving[1][::-1], leaving[2][::-1])]
    count = core_n + come[0] + stay[0]
    s1, s2 = come[1] + stay[1], come[2] + stay[2] + (told[M2][0] if told else 0.0)
    least = np.minimum(np.minimum(come[3], stay[3]), told[LEAST][0] if told else np.inf)
    most = np.maximum(np.maximum(come[4], stay[4]), told[MOST][0] if told else -np.inf)
    some = np.maximum(count, 1)
    std = np.where(count > 1, np.sqrt(np.maximum(s2 - s1 * s1 / some, 0.0) / np.maximum(count - 1, 1)), 0.0)
    one = least == most
    mean = np.where(count > 0, np.where(one, least, center + s1 / some), np.nan)
    median = _medians(own, leaving, core[1:], list(zip(times.tolist(), (times - length).tolist())), below, core_n)
    return pd.DataFrame({"k": pdf["k"].iloc[0], "t": times, "mean": mean, "median": median, "std": np.where(one, 0.0, std), "count": count.astype("int64")})


def _stats(rows: DataFrame, days: int, slice_rows: int, key_type: str) -> DataFrame:
    """k, t, mean, median, std, count of the window at each time of ``rows`` (k, t, v, n: written)."""
    length = days * DAY
    m = written(_slices(rows, days, slice_rows), "slices")
    rows = rows.join(if_small(m), "k").withColumn("j", _whole(c("t"), _whole(F.lit(length), c("m"))))
    outer = F.array(F.struct(c("j").alias("j"), F.lit(OWN).alias("kind")), F.struct((c("j") + c("m")).alias("j"), F.lit(LEAVING).alias("kind")))
    sent = rows.select("k", "t", "v", "n", F.explode(outer).alias("x")).select("k", "x.j", "x.kind", "t", "v", "n")
    if not m.where(c("m") > 1).isEmpty():
        sent = sent.unionByName(_core(rows.where(c("m") > 1), key_type))
    schema = f"k {key_type}, t long, mean double, median double, std double, count long"

    def slice_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        return _window_stats(pdf, length)

    return sent.groupBy("k", "j").applyInPandas(slice_stats, schema)


def rolling_time_stats_blocked(df: DataFrame, key: str, ts: str, value: str, windows=("7D", "30D"),
                               prefix: str | None = None, id_col: str | None = None, slice_rows: int | None = None) -> DataFrame:
    """All ``windows`` for one key: ``df`` with their statistics, joined by key and time.

    Keys, times and values are written once, equal ones as one with their number. Rows with a
    NULL key or timestamp match no statistics.
    """
    prefix = prefix or key
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(c(key).alias("k"), micros(c(ts)).alias("t"), c(value).cast("double").alias("v")).where(c("k").isNotNull() & c("t").isNotNull())
    rows = written(rows.groupBy("k", "t", "v").agg(F.count(F.lit(1)).alias("n")), "timed-values")
    out = df.withColumn("_t", micros(c(ts)))
    for w in windows:
        names = stat_names(prefix, w)
        stats = _stats(rows, _WINDOW_DAYS[w], slice_rows or SLICE_ROWS, key_type)
        stats = stats.select(c("k").alias("_k"), c("t").alias("_t"), *[c(x).alias(name) for x, name in zip(("mean", "median", "std", "count"), names)])
        out = out.join(stats.withColumnRenamed("_t", "_at"), (c(key) == c("_k")) & (c("_t") == c("_at")), "left").drop("_k", "_at")
        out = out.withColumn(names[3], F.coalesce(c(names[3]), F.lit(0).cast("long")))
    return out.drop("_t")
