"""Formulas on a page: lines that lost their layout, boxes of whole formulas,
symbols without a known character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

#: Height of the bands by which symbols find the lines of their page.
CELL = 64.0


def _runs(lines: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Adds _flag and _run: flagged lines next to each other share a run, which is null for others."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = lines.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("_others", F.sum((~F.col("_flag")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("_run", F.when(F.col("_flag"), F.col("_others"))).drop("_others")


def without_broken_formulas(df: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """key, text: every run of up to `most` formula-like lines that holds an
    unknown symbol becomes one marker.

    Only texts with such a symbol are taken apart, in one shuffle; others, null
    ones included, stay as they are. Rows of one key stay rows of their own,
    repeated and null keys too.
    """
    hard = F.coalesce(F.col(text).rlike(T.UNKNOWN), F.lit(False))
    rows = df.select(key, text, F.monotonically_increasing_id().alias("_row"))
    lines = _runs(rows.filter(hard).select("_row", key, F.posexplode(F.split(text, "\n", -1)).alias("_n", "_line")), ["_row"], "_n", T.mathish(F.col("_line")))
    run = Window.partitionBy("_row", "_run")
    broken = F.col("_flag") & (F.count(F.lit(1)).over(run) <= most) & F.max(F.col("_line").rlike(T.UNKNOWN)).over(run)
    first = F.min("_n").over(run) == F.col("_n")
    kept = lines.select("_row", key, "_n", F.when(~broken, F.col("_line")).when(first, F.lit("⟦FORMULA⟧")).alias("_line")).filter("_line IS NOT NULL")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda s: s["_line"]), "\n")
    return rows.filter(~hard).select(key, text).unionByName(kept.groupBy("_row", key).agg(whole.alias(text)).drop("_row"))


def formula_spans(lines: DataFrame, by: list[str], most: int = 12, height: float = 90.0, pad: float = 2.0) -> DataFrame:
    """by, first, last, x0, y0, x1, y1, marker: runs of up to `most` formula-like
    lines (line, text, x0, top, x1, bottom) with a relation sign, no higher than
    `height`, and their padded boxes. A line with a host (`layout.attached`), if
    that column is there, belongs to no formula."""
    flag = T.mathish(F.col("text"))
    if "host" in lines.columns:
        flag = flag & F.col("host").isNull()
    rows = _runs(lines, by, "line", flag).filter("_flag")
    found = rows.groupBy(*by, "_run").agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("_n"), F.max(F.col("text").rlike(T.RELATION)).alias("_related"),
        (F.max_by("bottom", "line") - F.min_by("top", "line")).alias("_height"),
        F.min("x0").alias("_x0"), F.min("top").alias("_y0"), F.max("x1").alias("_x1"), F.max("bottom").alias("_y1"),
    )
    found = found.filter((F.col("_n") <= most) & F.col("_related") & (F.col("_height") <= height))
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0.0))
    box = found.select(*by, "first", "last", low("_x0").alias("x0"), low("_y0").alias("y0"), (F.col("_x1") + pad).alias("x1"), (F.col("_y1") + pad).alias("y1"))
    return box.withColumn("marker", F.format_string("⟦FORMULA:%.1f,%.1f,%.1f,%.1f⟧", "x0", "y0", "x1", "y1"))


def marked_symbols(lines: DataFrame, symbols: DataFrame, by: list[str]) -> DataFrame:
    """by, line, text: lines (line, text, x0, x1, top, bottom) in which single
    (cid:N) become anchors ⟦G:i⟧ of the page's symbols (symbol, x0, x1, top,
    bottom), and groups of them, or those without a symbol, [?].

    The symbols inside a line's box, 4 wider and 8 higher, are dealt out from
    the left to all (cid:N) of the line. Codes up to three characters apart are
    a group. Lines and symbols of a page meet by bands of its height.
    """
    single = r"\(cid:\d+\)"
    group = rf"{single}(?:[\s\S]{{0,3}}?{single})*+"
    coded = F.coalesce(F.col("text").rlike(single), F.lit(False))
    cell = lambda y: F.floor(y / CELL)
    asked = lines.filter(coded).select(*by, "line", "x0", "x1", "top", "bottom", F.explode(F.sequence(cell(F.col("top") - 8), cell(F.col("bottom") + 8))).alias("_cell"))
    given = symbols.select(*by, "symbol", *[F.col(c).alias(f"s_{c}") for c in ("x0", "x1", "top", "bottom")], cell(F.col("top")).alias("_cell"))
    inside = (F.col("s_x0") >= F.col("x0") - 4) & (F.col("s_x1") <= F.col("x1") + 4) & (F.col("s_top") >= F.col("top") - 8) & (F.col("s_bottom") <= F.col("bottom") + 8)
    held = asked.join(given, [*by, "_cell"]).filter(inside).groupBy(*by, "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_x0", "symbol"))), lambda s: s["symbol"]).alias("_held"))

    rows = lines.filter(coded).select(*by, "line", "text").join(held, [*by, "line"], "left")
    groups = F.regexp_extract_all("text", F.lit(group), F.lit(0))
    counts = F.transform(groups, lambda g: F.regexp_count(g, F.lit(single)))
    # the place of each group's first symbol: the codes before it
    starts = F.aggregate(counts, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)))
    anchor = lambda c, s: F.when(c == 1, s)
    rows = rows.withColumn("_counts", counts).withColumn("_starts", F.slice(starts, 1, F.size(counts)))
    rows = rows.withColumn("_at", F.zip_with("_counts", "_starts", anchor))
    signs = F.transform("_at", lambda i: F.coalesce(F.concat(F.lit("⟦G:"), F.get("_held", i).cast("string"), F.lit("⟧")), F.lit("[?]")))
    text = F.array_join(F.zip_with(F.split("text", group, -1), F.concat(signs, F.array(F.lit(""))), lambda t, s: F.concat(t, s)), "")
    return lines.filter(~coded).select(*by, "line", "text").unionByName(rows.select(*by, "line", text.alias("text")))
