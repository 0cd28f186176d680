"""Formulas: runs, boxes, anchors, and texts in a font's characters, on small cases."""

from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as T
from quire.operators import formulas

LINE = "p int, line int, text string, x0 double, x1 double, top double, bottom double"
SYMBOL = "p int, symbol int, x0 double, x1 double, top double, bottom double"


def test_formula_like_lines(spark):
    given = {
        "are assumed: α = 0.05, d = 2 nm, and so": False, "in of as": False, "ndm gp": True, "x": True, "": False, None: False, "⟦G:12⟧ alpha": True,
        "a → b goes on": False, "up to ∑ others": True, "x² abc": True, "(cid:4)": True, "a = " + "b " * 90: False,
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", T.mathish(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == given | {"up to ∑ others": False}


def test_broken_formulas(spark):
    long_run = "\n".join(["[?]"] + ["x"] * 10)
    given = {
        1: "x = 2\n[?] a\nplain words of prose\n⟦G:3⟧\n", 2: None, 3: "", 4: "x = 2\n3 (1)", 5: long_run, 6: long_run[:-2], 7: "[?]\nplain words of prose\n[?]",
    }
    rows = spark.createDataFrame(list(given.items()), "k int, t string").withColumn("_n", F.lit(1))
    got = {r.k: r.t for r in formulas.without_broken_formulas(rows, "k", "t").collect()}
    mark = "⟦FORMULA⟧"
    assert got == {1: f"{mark}\nplain words of prose\n{mark}\n", 2: None, 3: "", 4: given[4], 5: long_run, 6: mark, 7: f"{mark}\nplain words of prose\n{mark}"}
    assert formulas.without_broken_formulas(rows.limit(0), "k", "t").count() == 0


def test_formula_spans(spark):
    rows = [(1, 0, "words of plain prose", 0.0, 9.0, 0.0, 9.0), (1, 1, "y = 2", 1.0, 30.0, 10.0, 19.0), (1, 2, "x", 5.0, 40.0, 20.0, 29.0), (1, 3, "3", 5.0, 9.0, 30.0, 39.0), (2, 0, "3", 0.0, 9.0, 0.0, 9.0), (3, 0, "a = b", 0.0, 9.0, 0.0, 9.0), (3, 1, "c", 0.0, 9.0, 80.0, 91.0)]
    lines = spark.createDataFrame(rows, LINE)
    (got,) = formulas.formula_spans(lines, ["p"]).collect()
    assert (got.p, got["first"], got["last"], got.marker) == (1, 1, 3, "⟦FORMULA:0.0,8.0,42.0,41.0⟧")
    attached = lines.withColumn("host", F.when((F.col("p") == 1) & (F.col("line") == 3), 0))
    (got,) = formulas.formula_spans(attached, ["p"]).collect()
    assert (got["last"], got.y1) == (2, 31.0)


def test_anchors_of_symbols(spark):
    lines = spark.createDataFrame([(1, 0, "a (cid:1) b then (cid:2)(cid:3), last (cid:9)", 0.0, 100.0, 60.0, 70.0), (1, 1, "none", 0.0, 9.0, 80.0, 90.0), (1, 2, None, 0.0, 9.0, 80.0, 90.0), (2, 0, "(cid:1)", 0.0, 9.0, 0.0, 9.0)], LINE)
    symbols = spark.createDataFrame([(1, 4, 10.0, 12.0, 53.0, 60.0), (1, 5, 20.0, 22.0, 65.0, 70.0), (1, 3, 20.0, 22.0, 65.0, 70.0), (1, 8, 90.0, 104.0, 64.0, 78.0), (1, 9, 50.0, 60.0, 40.0, 66.0)], SYMBOL)
    got = {(r.p, r.line): r.text for r in formulas.marked_symbols(lines, symbols, ["p"]).collect()}
    assert got == {(1, 0): "a ⟦G:4⟧ b then [?], last ⟦G:8⟧", (1, 1): "none", (1, 2): None, (2, 0): "[?]"}


def test_text_in_a_font(spark):
    given = {"H₂O ⇒ x²\n": "H2O => x ", None: "", "": "", "T꜀—漢": "T_C-", "]^-\\": "]^-\\"}
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", markup.in_font(F.col("t"), [(0x20, 0x7E)]).alias("s")).collect()
    assert {r.t: r.s for r in rows} == given
    kept = spark.range(1).select(markup.in_font(F.lit("H₂O—漢"), [(0x20, 0x7E), (0x2080, 0x2089), (0x2014, 0x2014), (0x6F22, 0x6F22)]).alias("s")).first()
    assert kept.s == "H₂O—漢"
