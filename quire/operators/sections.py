"""Canonical sections and outlines of papers held as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

NUMERIC = r"^\s*(\d+(?:\.\d+)?)\.?\s+([A-Z][A-Za-z][A-Za-z \t-]{1,80})\s*$"
ROMAN = r"^\s*([IVX]+)\.?\s+([A-Z][A-Z]+(?:[ \t]+[A-Z]+){0,8})\s*$"
PREAMBLE, LEAST = 50, 30
NOISE = r"^\d{1,4}$|\bVol\.\s*\d+|\bDOI\s*:"
REFERENCES = r"(?i)^(?:\d{1,3}\s+)?references\s*$"
FORMULA = r"⟦FORMULA:[^⟧\n]*⟧"


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page, n (line in page), line of pages (doc, page, text)."""
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))


def headings(lines: DataFrame) -> DataFrame:
    """Adds number, title, section to lines; null but for recognised headings."""
    number = F.coalesce(F.nullif(F.regexp_extract("line", NUMERIC, 1), F.lit("")), F.nullif(F.regexp_extract("line", ROMAN, 1), F.lit("")))
    title = F.btrim(F.coalesce(F.nullif(F.regexp_extract("line", NUMERIC, 2), F.lit("")), F.nullif(F.regexp_extract("line", ROMAN, 2), F.lit(""))), F.lit(T.BLANK))
    found = lines.withColumn("number", number).withColumn("title", title).withColumn("section", T.section_of(F.col("title")))
    return found.withColumns({c: F.when(F.col("section").isNotNull(), F.col(c)) for c in ("number", "title")})


def sectioned(pages: DataFrame) -> DataFrame:
    """doc, nth, section, title, number, text, page_start, page_end.

    Text between recognised headings; before the first one a preamble if it is
    over 50 characters; sections under 30 go; a document without headings is
    one full_text row. A document's lines are ordered in one task, a page's
    text being the unit of input.
    """
    rows = headings(page_lines(pages))
    order = Window.partitionBy("doc").orderBy("page", "n")
    rows = rows.withColumn("nth", F.count("section").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("page", "n", F.when(F.col("section").isNull(), F.col("line")).alias("line"))
    parts = rows.groupBy("doc", "nth").agg(
        F.max("section").alias("section"), F.max("title").alias("title"), F.max("number").alias("number"),
        F.sort_array(F.collect_list(line)).alias("lines"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    text = F.btrim(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), F.lit(T.BLANK))
    parts = parts.withColumn("text", text).withColumn("known", F.max("nth").over(Window.partitionBy("doc")) > 0)
    parts = parts.withColumn("section", F.when(~F.col("known"), "full_text").when(F.col("nth") == 0, "preamble").otherwise(F.col("section")))
    parts = parts.withColumn("title", F.when(~F.col("known"), "Full Text").when(F.col("nth") == 0, "Preamble").otherwise(F.col("title")))
    kept = ~F.col("known") | F.when(F.col("nth") == 0, F.length("text") > PREAMBLE).otherwise(F.length("text") >= LEAST)
    return parts.filter(kept).select("doc", "nth", "section", "title", "number", "text", "page_start", "page_end")


def outline(pages: DataFrame) -> DataFrame:
    """doc, nth, title, level, text, formulas, page_start, page_end of numbered
    headings; nth 0 is the preamble. Noise lines go, each formula becomes
    【公式N】 counted in its section, and everything from the first references
    heading on is left out."""
    rows = page_lines(pages).withColumn("line", F.btrim("line", F.lit(T.BLANK)))
    order = Window.partitionBy("doc").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ended", F.max(F.col("line").rlike(REFERENCES)).over(order)).filter(~F.col("ended") & ~F.col("line").rlike(NOISE))
    rows = rows.withColumn("title", T.outline_title(F.col("line"))).withColumn("level", F.when(F.col("title").isNotNull(), T.outline_level(F.col("line"))))
    rows = rows.withColumn("nth", F.count("title").over(order))
    line = F.struct("page", "n", F.when(F.col("title").isNull() & (F.col("line") != ""), F.col("line")).alias("line"))
    parts = rows.groupBy("doc", "nth").agg(F.max("title").alias("title"), F.max("level").alias("level"), F.sort_array(F.collect_list(line)).alias("lines"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    text = F.array_join(F.transform("lines", lambda s: s["line"]), "\n")
    pieces = F.split(text, FORMULA, -1)
    numbered = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("【公式"), i.cast("string"), F.lit("】"), p))), "")
    return parts.select("doc", "nth", "title", "level", numbered.alias("text"), (F.size(pieces) - 1).alias("formulas"), "page_start", "page_end")
