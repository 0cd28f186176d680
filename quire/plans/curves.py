"""Curve queries on price series of lineitem: a return flag is a series, a ship
day an x, the mean price a y; every seventh day stands for the paper's curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import curves
from quire.plans.registry import query
from quire.session import table

DAYS = """days AS (SELECT l_returnflag AS series, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS x,
 avg(l_extendedprice) AS py, avg(l_extendedprice * (1 - l_discount * 0.4)) AS y FROM lineitem GROUP BY 1, 2),
paper AS (SELECT series, x, py AS y FROM days WHERE x::BIGINT % 7 = 0)"""
POINTS = f"""{DAYS},
ends AS (SELECT series, min(x) lo, max(x) hi, arg_min(y, x) ylo, arg_max(y, x) yhi FROM paper GROUP BY series),
l AS (SELECT d.series, d.x, d.y, p.x AS ax, p.y AS ay FROM days d ASOF LEFT JOIN paper p ON d.series = p.series AND d.x >= p.x),
b AS (SELECT l.*, p.x AS bx, p.y AS bv FROM l ASOF LEFT JOIN paper p ON l.series = p.series AND l.x < p.x),
pts AS (SELECT b.series, b.x, b.y, CASE WHEN b.x <= e.lo THEN e.ylo WHEN b.x >= e.hi THEN e.yhi
 ELSE ay * (1 - (b.x - ax) / (bx - ax)) + bv * ((b.x - ax) / (bx - ax)) END AS paper_y FROM b JOIN ends e USING (series))"""


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    x = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    days = items.groupBy(F.col("l_returnflag").alias("series"), x.alias("x")).agg(F.avg("l_extendedprice").alias("py"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount") * 0.4)).alias("y"))
    pos = F.lit(0).alias("pos")
    return days.filter(F.col("x").cast("long") % 7 == 0).select("series", "x", F.col("py").alias("y"), pos), days.select("series", "x", "y", pos)


@query("curve_compare", f"""WITH {POINTS},
s AS (SELECT series, count(*) AS n, sum((y - paper_y) ** 2) AS ss, avg(abs(y - paper_y)) AS mae, max(abs(y - paper_y)) AS mx,
 max(abs((y - paper_y) / paper_y) * 100) AS mr, avg(abs((y - paper_y) / paper_y) * 100) AS ar, corr(paper_y, y) AS r, var_pop(y) * count(*) AS tot FROM pts GROUP BY series)
SELECT series, n AS n_points, round(sqrt(ss / n), 4) AS rmse, round(mae, 4) AS mae, round(mx, 4) AS max_abs_err, round(mr, 4) AS max_rel_err_pct, round(ar, 4) AS avg_rel_err_pct,
 round(r, 6) AS pearson_r, round(1 - ss / tot, 6) AS r_squared, CASE WHEN mr <= 5 THEN 'pass' WHEN mr <= 20 THEN 'warn' ELSE 'fail' END AS verdict FROM s""")
def curve_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper, points = series(spark, sf_dir)
    out = curves.compared(curves.interpolated(paper, points, "series", 64.0), "series")
    places = {"pearson_r": 6, "r_squared": 6, "rmse": 4, "mae": 4, "max_abs_err": 4, "max_rel_err_pct": 4, "avg_rel_err_pct": 4}
    return out.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in out.columns])


@query("curve_points", f"""WITH {POINTS} SELECT series, x, round(y, 3) AS y, round(paper_y, 3) AS paper_y FROM pts
QUALIFY row_number() OVER (PARTITION BY series ORDER BY x) <= 100""")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-point table of a comparison, 100 points a series."""
    from pyspark.sql.window import Window

    paper, points = series(spark, sf_dir)
    out = curves.interpolated(paper, points, "series", 64.0).withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy("x")))
    return out.filter("n <= 100").select("series", "x", F.round("y", 3).alias("y"), F.round("paper_y", 3).alias("paper_y"))


@query("csv_points", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y, (l_orderkey + l_linenumber) % 8 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, x, y FROM t WHERE k IN (0, 1, 2, 3)""")
def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lines in all forms the parser knows, four of which hold a point."""
    items = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity").cast("string"), F.col("l_tax").cast("string")
    forms = [F.concat(x, F.lit(", "), y), F.concat(x, F.lit("\t"), y), F.concat(x, F.lit(";"), y, F.lit(" ")), F.concat(F.lit(" "), x, F.lit("  "), y), F.concat(F.lit("# "), x, F.lit(","), y), F.concat(x, F.lit(","), y, F.lit(",9")), F.concat(F.lit("nan,"), y), F.lit("V_G,I_D")]
    line = F.get(F.array(*forms), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int"))
    return curves.parse_points(items.select("l_orderkey", "l_linenumber", line.alias("value"))).select("l_orderkey", "l_linenumber", "x", "y")


@query("calibrated_points", "SELECT event_id, round(2.0 + (value - 10) * (12.0 - 2.0) / (190 - 10), 6) AS x FROM events WHERE value IS NOT NULL")
def calibrated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = curves.calibrated(F.col("value"), F.lit(10.0), F.lit(2.0), F.lit(190.0), F.lit(12.0))
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.round(x, 6).alias("x"))


PIXELS = "px AS (SELECT l_shipdate::DATE AS day, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in pixels: three keys of a line item give a colour, its ship month a picture."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.date_format("l_shipdate", "yyyy-MM").alias("picture"), *[(F.col(c) % 256).alias(k) for c, k in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b"))], F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"))


@query("dominant_colour", """WITH px AS (SELECT strftime(l_shipdate, '%Y-%m') AS picture, (l_orderkey % 256) // 32 AS r, (l_partkey % 256) // 32 AS g, (l_suppkey % 256) // 32 AS b FROM lineitem),
c AS (SELECT picture, r, g, b, count(*) AS n FROM px GROUP BY ALL)
SELECT picture, r::INT AS r, g::INT AS g, b::INT AS b, n FROM c QUALIFY row_number() OVER (PARTITION BY picture ORDER BY n DESC, r, g, b) = 1""")
def dominant_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.dominant_colour(pixels(spark, sf_dir), "picture")


@query("colour_mask", """WITH px AS (SELECT strftime(l_shipdate, '%Y-%m') AS picture, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)
SELECT picture, count(*) AS n FROM px WHERE greatest(r, g, b) / 255.0::DOUBLE >= 0.4 AND (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) >= 0.5 GROUP BY picture""")
def colour_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pixels(spark, sf_dir).filter(curves.hsv_close(F.col("r"), F.col("g"), F.col("b"), 0.5, 0.4))
    return kept.groupBy("picture").agg(F.count(F.lit(1)).alias("n"))


@query("column_median", "SELECT strftime(l_shipdate, '%Y-%m') AS picture, l_linenumber AS x, median(l_quantity) AS y FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3")
def column_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median y of each pixel column that has three pixels."""
    rows = pixels(spark, sf_dir).groupBy("picture", "x").agg(F.median("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return rows.filter("n >= 3").select("picture", "x", "y")


@query("edge_colours", """WITH px AS (SELECT l_suppkey AS page, l_partkey % 40 AS y, l_orderkey % 300 AS x, l_linenumber * 16 AS r, l_linenumber % 2 * 32 AS g, (l_quantity % 4)::INT * 64 AS b FROM lineitem),
s AS (SELECT page, r, g, b, sum((y = 0)::INT + (y = 1)::INT + (y = h - 2)::INT + (y = h - 1)::INT) AS n, min((y, x)) AS first FROM px JOIN (SELECT page, 20 + page % 21 AS h FROM (SELECT DISTINCT page FROM px)) USING (page) WHERE y IN (0, 1, h - 2, h - 1) GROUP BY page, r, g, b),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first, r, g, b) = 1)
SELECT s_suppkey AS page, coalesce(r / 255.0::DOUBLE, 1) AS r, coalesce(g / 255.0::DOUBLE, 1) AS g, coalesce(b / 255.0::DOUBLE, 1) AS b FROM supplier LEFT JOIN t ON page = s_suppkey""")
def edge_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of their supplier's page, whose paper has the colour of its edges."""
    k = F.col
    px = table(spark, sf_dir, "lineitem").select(k("l_suppkey").alias("page"), (k("l_partkey") % 40).alias("y"), (k("l_orderkey") % 300).alias("x"), (k("l_linenumber") * 16).alias("r"), (k("l_linenumber") % 2 * 32).alias("g"), ((k("l_quantity") % 4).cast("int") * 64).alias("b"))
    return curves.edge_colour(px, table(spark, sf_dir, "supplier").select(k("s_suppkey").alias("page"), (20 + k("s_suppkey") % 21).alias("height")), "page")
