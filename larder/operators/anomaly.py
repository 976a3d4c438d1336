"""Z-score detectors and time-ordered cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def global_zscore(df: DataFrame, value: str, name: str, threshold: float = 3.0,
                  flag: str | None = None) -> DataFrame:
    """(x - mean) / std over all rows; std <= 0 or undefined -> 1.

    The mean/std come from one global aggregate (one row, broadcast); the
    score is then a narrow projection, no shuffle of the rows.
    """
    s = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    s = s.select("_m", F.when(c("_sd") > 0, c("_sd")).otherwise(F.lit(1.0)).alias("_sd"))
    out = df.crossJoin(F.broadcast(s)).withColumn(name, (c(value) - c("_m")) / c("_sd"))
    if flag:
        out = out.withColumn(flag, F.abs(c(name)) > F.lit(threshold))
    return out.drop("_m", "_sd")


def fold_segments(df: DataFrame, ts: str, n_splits: int = 5) -> DataFrame:
    """Distinct calendar dates -> contiguous segment number 1..n.

    When there are fewer dates than ``n_splits`` the number of segments is
    max(2, #dates). The first (#dates % n) segments get one extra date (the
    array_split rule). Computed on one row per date, never on fact rows.
    """
    dates = df.where(c(ts).isNotNull()).select(F.to_date(ts).alias("date")).distinct()
    w_all = Window.partitionBy()
    k = F.count(F.lit(1)).over(w_all)
    n = F.when(k < n_splits, F.greatest(F.lit(2), k)).otherwise(F.lit(n_splits))
    i = F.row_number().over(w_all.orderBy("date")) - 1
    d = dates.select("date", k.alias("_k"), n.alias("_n"), i.alias("_i"))
    q = F.floor(c("_k") / c("_n"))
    r = c("_k") - q * c("_n")
    big = r * (q + 1)
    seg = F.when(c("_i") < big, F.floor(c("_i") / (q + 1))).otherwise(r + F.floor((c("_i") - big) / q))
    return d.select("date", (seg + 1).cast("int").alias("segment"))


def with_segments(df: DataFrame, ts: str, n_splits: int = 5) -> DataFrame:
    """Attach the segment of each row's date. The date->segment table has one
    row per calendar day, so it is broadcast (bounded by days, not rows)."""
    seg = fold_segments(df, ts, n_splits)
    return df.withColumn("date", F.to_date(ts)).join(seg, "date", "left")


def fold_table(seg: DataFrame) -> DataFrame:
    """Folds i = 1..n-1: train on segments <= i, test on segment i + 1."""
    n = seg.agg(F.max("segment").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(1), c("n") - 1)).alias("fold"))


def zscore_folds(df: DataFrame, ts: str, value: str, n_splits: int = 5, threshold: float = 3.0) -> DataFrame:
    """Per fold: train size, test size, mean/std of ``value`` on train, and the
    number of test rows with |z| > threshold (M02).

    All folds in one job: per-segment partial moments (n, sum, sum of squares)
    are accumulated over segments with a running window on the tiny segment
    table, then each row is scored once, against the fold whose test segment
    it belongs to.
    """
    rows = with_segments(df, ts, n_splits).where(c("segment").isNotNull())
    x = c(value).cast("double")
    mom = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    cum = mom.select(
        c("segment").alias("fold"),
        F.sum("rows").over(w).alias("n_train"), F.sum("n").over(w).alias("_n"),
        F.sum("s1").over(w).alias("_s1"), F.sum("s2").over(w).alias("_s2"))
    nxt = mom.select((c("segment") - 1).alias("fold"), c("rows").alias("n_test"))
    folds = cum.join(nxt, "fold")
    mean = c("_s1") / c("_n")
    var = (c("_s2") - c("_s1") * c("_s1") / c("_n")) / (c("_n") - 1)
    sd = F.when(c("_n") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
    folds = folds.select("fold", "n_train", "n_test", mean.alias("train_mean"),
                         F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("train_std"))
    scored = rows.join(folds.withColumn("segment", c("fold") + 1), "segment")
    z = F.abs((x - c("train_mean")) / c("train_std"))
    counts = scored.groupBy("fold").agg(F.count_if(z > threshold).alias("z_anomalies"))
    return folds.join(counts, "fold", "left").select(
        "fold", "n_train", "n_test", "train_mean", "train_std",
        F.coalesce(c("z_anomalies"), F.lit(0)).alias("z_anomalies"))
