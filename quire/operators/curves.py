"""Curves: point parsing, calibration, interpolation, reproduction metrics, pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-12
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_points(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds x, y from two-column text lines and drops all other lines: blank
    ones, `#` and `//` comments, headers, numbers that aren't finite, and lines
    with further columns that aren't empty."""
    line = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), "[\t;]", ",")
    parts = F.when(F.contains(line, F.lit(",")), F.split(line, ",", -1)).otherwise(F.split(line, r"\s+", -1))
    cell = lambda i: F.btrim(F.get(F.col("_p"), F.lit(i)), F.lit(" \t"))
    rest = F.forall(F.slice("_p", 3, 1_000_000), lambda p: F.btrim(p, F.lit(" \t")) == "")
    rows = lines.withColumn("_l", line).filter((F.col("_l") != "") & ~F.col("_l").rlike("^(#|//)"))
    rows = rows.withColumn("_p", parts).filter((F.size("_p") >= 2) & rest & cell(0).rlike(NUMBER) & cell(1).rlike(NUMBER))
    rows = rows.withColumn("x", cell(0).try_cast("double")).withColumn("y", cell(1).try_cast("double"))
    return rows.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).drop("_l", "_p")


def calibrated(p: Column, p0: Column, r0: Column, p1: Column, r1: Column) -> Column:
    """A pixel coordinate on the axis through (p0, r0) and (p1, r1); null if p0 = p1."""
    return r0 + F.try_divide((p - p0) * (r1 - r0), p1 - p0)


def interpolated(paper: DataFrame, points: DataFrame, series: str, cell: float) -> DataFrame:
    """points (series, x, y, pos) with paper_y, the paper curve (series, x, y,
    pos) at x: linear inside, the end values outside; of repeated paper x the
    last counts, at the first x the first. Series without a paper curve are
    left out.

    Rows are dealt by series and cell of x, `cell` wide; what lies before and
    after a cell comes from a summary of a row a cell, so a long series isn't
    sorted in one task.
    """
    of = lambda d, side: d.select(series, "x", "y", "pos", F.lit(side).alias("side"), F.floor(F.col("x") / cell).alias("cell"))
    rows = of(paper, 0).unionByName(of(points, 1))
    point = F.when(F.col("side") == 0, F.struct("x", "pos", "y"))
    cells = rows.groupBy(series, "cell").agg(F.min(point).alias("low"), F.max(point).alias("high"))
    by_cell = Window.partitionBy(series).orderBy("cell")
    everywhere = Window.partitionBy(series)
    cells = cells.select(
        F.col(series).alias("_s"), F.col("cell").alias("_c"),
        F.last("high", True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.first("low", True).over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
        F.min("low").over(everywhere).alias("first"), F.max("high").over(everywhere).alias("last"),
    )
    order = Window.partitionBy(series, "cell").orderBy("x", "side", "pos")
    rows = rows.withColumn("p", point)
    rows = rows.withColumn("lo", F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("hi", F.first("p", True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.filter("side = 1").join(cells, (F.col(series) == F.col("_s")) & (F.col("cell") == F.col("_c"))).filter("first is not null")
    lo, hi, x = F.coalesce("lo", "left"), F.coalesce("hi", "right"), F.col("x")
    t = (x - lo["x"]) / (hi["x"] - lo["x"])
    y = F.when(x <= F.col("first.x"), F.col("first.y")).when(x >= F.col("last.x"), F.col("last.y")).otherwise(lo["y"] * (1 - t) + hi["y"] * t)
    return rows.select(series, "x", "y", "pos", y.alias("paper_y"))


def compared(points: DataFrame, series: str, pass_pct: float = 5.0, warn_pct: float = 20.0) -> DataFrame:
    """Metrics and verdict by series of rows with y and paper_y."""
    d, p, y = F.col("y") - F.col("paper_y"), F.col("paper_y"), F.col("y")
    rel = F.when(F.abs(p) > EPS, F.abs(d / p) * 100)
    sums = points.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_points"), F.sum(d * d).alias("ss"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs_err"),
        F.count(rel).alias("n_rel"), F.max(rel).alias("max_rel"), F.avg(rel).alias("avg_rel"),
        F.var_pop(p).alias("vp"), F.var_pop(y).alias("vy"), F.covar_pop(p, y).alias("cov"),
    )
    n = F.col("n_points")
    denom = F.sqrt(F.col("vp") * F.col("vy")) * n
    verdict = F.when(F.col("n_rel") == 0, "inconclusive").when(F.col("max_rel") <= pass_pct, "pass").when(F.col("max_rel") <= warn_pct, "warn").otherwise("fail")
    return sums.select(
        series, "n_points", F.sqrt(F.col("ss") / n).alias("rmse"), "mae", "max_abs_err",
        F.coalesce("max_rel", F.lit(0.0)).alias("max_rel_err_pct"), F.coalesce("avg_rel", F.lit(0.0)).alias("avg_rel_err_pct"),
        F.when((n > 1) & (denom > EPS), F.try_divide(F.col("cov") * n, denom)).otherwise(0.0).alias("pearson_r"),
        F.when((n > 1) & (F.col("vy") * n > EPS), 1 - F.try_divide(F.col("ss"), F.col("vy") * n)).otherwise(0.0).alias("r_squared"),
        verdict.alias("verdict"),
    )


def hsv_close(r: Column, g: Column, b: Column, least_saturation: float, least_value: float) -> Column:
    """Whether a pixel is coloured and bright enough."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return (top / 255.0 >= least_value) & (F.when(top > 0, (top - low) / top).otherwise(0.0) >= least_saturation)


def dominant_colour(pixels: DataFrame, by: str, bucket: int = 32) -> DataFrame:
    """The most frequent colour bucket of each group, ties to the smallest."""
    at = [F.floor(F.col(c) / bucket).cast("int").alias(c) for c in "rgb"]
    counts = pixels.select(by, *at).groupBy(by, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(by).agg(F.max(F.struct("n", (-F.col("r")).alias("r"), (-F.col("g")).alias("g"), (-F.col("b")).alias("b"))).alias("t"))
    return top.select(by, (-F.col("t.r")).alias("r"), (-F.col("t.g")).alias("g"), (-F.col("t.b")).alias("b"), F.col("t.n").alias("n"))


def edge_colour(pixels: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """by, r, g, b from 0 to 1 of the paper: the most frequent colour of the two top
    and two bottom rows of a page's pixels (y, x, r, g, b), ties to the one met first
    by row and column, then to the smallest. `pages` (by, height) names the pages; one without pixels is white."""
    at, last = F.col("y"), F.col("height")
    times = sum(((at == row).cast("int") for row in (F.lit(0), F.lit(1), last - 2, last - 1)), F.lit(0))
    rows = pixels.join(pages.select(by, "height"), by).withColumn("_n", times).filter("_n > 0")
    counts = rows.groupBy(by, "r", "g", "b").agg(F.sum("_n").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    top = counts.groupBy(by).agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("first.y"), -F.col("first.x"), -F.col("r"), -F.col("g"), -F.col("b"))).alias("c"))
    return pages.select(by).join(top, by, "left").select(by, *[F.coalesce(F.col(f"c.{k}") / 255.0, F.lit(1.0)).alias(k) for k in "rgb"])
