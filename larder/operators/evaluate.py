"""Detector evaluation against a label: M07-M09."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.semantics import rnd
from larder.session import checkpoint_dir

c = F.col
LABELS = ("anomaly", "label", "is_anomaly")  # fixed values, in order of preference


def label_column(df: DataFrame) -> str | None:
    """The first label column that the table has."""
    names = {n.lower(): n for n in df.columns}
    return next((names[n] for n in LABELS if n in names), None)


def precision_recall(df: DataFrame, label: Column, flags: dict[str, Column]) -> DataFrame:
    """Per detector tp, fp, fn, precision, recall, f1 (0 where undefined), in one pass."""
    yes = F.coalesce(label.cast("boolean"), F.lit(False))
    cells = []
    for i, f in enumerate(flags.values()):
        on = F.coalesce(f.cast("boolean"), F.lit(False))
        cells += [F.count_if(on & yes).alias(f"tp{i}"), F.count_if(on & ~yes).alias(f"fp{i}"), F.count_if(~on & yes).alias(f"fn{i}")]
    one = df.agg(*cells)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), *[c(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, n in enumerate(flags)])).alias("r")).select("r.*")
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = rows.withColumns({"precision": div(c("tp"), c("tp") + c("fp")), "recall": div(c("tp"), c("tp") + c("fn"))})
    f1 = div(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    return rows.select("detector", "tp", "fp", "fn", rnd("precision").alias("precision"), rnd("recall").alias("recall"), rnd(f1).alias("f1"))


def roc_auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row with the exact rank AUC; NULL where only one class has scores.

    Rows are reduced to one a distinct score; the running count of negatives goes by
    ranges of the scores first and then over the ranges, so no task holds all scores.
    """
    checkpoint_dir(df.sparkSession)
    yes = F.coalesce(label.cast("boolean"), F.lit(False))
    g = df.select(score.cast("double").alias("s"), yes.alias("y")).where(c("s").isNotNull()).groupBy("s").agg(F.count_if(c("y")).alias("pos"), F.count_if(~c("y")).alias("neg"))
    g = g.repartitionByRange("s").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = g.groupBy(c("part").alias("p")).agg(F.sum("neg").alias("n"))  # one row a range
    parts = parts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("below", below).join(parts, c("part") == c("p"))
    won = F.sum(c("pos") * (c("ahead") + c("below") + c("neg") / 2))
    return r.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), won.alias("won")).select(
        "positives", "negatives", rnd(F.try_divide(c("won"), c("positives").cast("double") * c("negatives"))).alias("auc"))
