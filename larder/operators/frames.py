"""Chart frames of bounded size (V06): a scatter plot as a grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.semantics import rnd

c = F.col


def scatter_frame(df: DataFrame, x: str, y: str, bins: int, by: str | None = None) -> DataFrame:
    """At most ``bins`` x ``bins`` cells (for each value of ``by``) between the least and the greatest x and y:
    rows, mean place and outermost points of each cell that holds any.

    However many rows there are, the frame has this size; its extremes are points of the data.
    """
    rows = df.where(c(x).isNotNull() & c(y).isNotNull())
    if by:
        rows = rows.where(c(by).isNotNull())
    rows = rows.select(*([by] if by else []), c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    span = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row

    def cell(v, lo, hi):
        inside = F.least(F.floor((c(v) - c(lo)) / ((c(hi) - c(lo)) / F.lit(float(bins)))), F.lit(bins - 1))
        return F.when(c(hi) == c(lo), F.lit(0)).otherwise(inside).cast("int")

    cells = rows.crossJoin(F.broadcast(span)).withColumns({"cell_x": cell("x", "x0", "x1"), "cell_y": cell("y", "y0", "y1")})
    return cells.groupBy(*([by] if by else []), "cell_x", "cell_y").agg(
        F.count(F.lit(1)).alias("points"), rnd(F.avg("x")).alias("mean_x"), rnd(F.avg("y")).alias("mean_y"),
        *[rnd(f(v)).alias(f"{n}_{v}") for v in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
