"""Layout, section and chunk queries. Lines of documents stand in for lines of a
page: line n of a text stands at 12 n, its length gives its width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import spacing
from quire.functions import text as T
from quire.operators import assembly, chunking, formulas, layout, sections
from quire.plans.registry import query
from quire.session import table

LINES = """l AS (SELECT doc_id, n, line, (12 * n + length(line) % 3)::DOUBLE AS top, (12 * n + length(line) % 3 + 9 + doc_id % 5)::DOUBLE AS bottom, (50 + length(line) % 4 * 6)::DOUBLE AS x0, (50 + length(line) % 4 * 6 + least(length(line), 500))::DOUBLE AS x1
 FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    k = F.length("line")
    top, x0 = (12 * F.col("n") + k % 3).cast("double"), (50 + k % 4 * 6).cast("double")
    rows = rows.withColumn("top", top).withColumn("bottom", top + 9 + F.col("doc_id") % 5).withColumn("x0", x0).withColumn("x1", x0 + F.least(k, F.lit(500)))
    return rows.withColumn("n", F.col("n").cast("long"))


@query("margins", f"WITH {LINES}, r AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM l) SELECT doc_id, x0 AS median FROM r WHERE k = c // 2")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.upper_median(lines(spark, sf_dir), ["doc_id"], "x0")


#: Every line counts; those of odd n stand in a right column.
RIGHT = 330
COVER = f"""{LINES}, k AS (SELECT doc_id, x1 - x0 AS w, x0 + n % 2 * {RIGHT} AS x0, x1 + n % 2 * {RIGHT} AS x1 FROM l),
b AS (SELECT doc_id, w, unnest(generate_series(least(greatest(floor(x0 / 700 * 120), 0), 119)::INT, least(greatest(floor(x1 / 700 * 120), 0), 119)::INT)) AS bin FROM k), c AS (SELECT doc_id, bin, sum(w) AS ink FROM b GROUP BY 1, 2)"""


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.col("n") % 2 * RIGHT
    return layout.coverage(lines(spark, sf_dir).withColumn("x0", F.col("x0") + right).withColumn("x1", F.col("x1") + right), ["doc_id"], 700.0)


@query("ink_coverage", f"WITH {COVER} SELECT doc_id, bin, ink FROM c")
def ink_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of all lines, in two columns."""
    return bins(spark, sf_dir)


@query("gutters", f"""WITH {COVER}, g AS (SELECT doc_id, bin, lead(bin) OVER (PARTITION BY doc_id ORDER BY bin) - bin - 1 AS length FROM c WHERE ink > 0)
SELECT doc_id, bin + 1 AS start, length FROM g WHERE length > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, bin) = 1""")
def gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between all lines, as they stand."""
    return layout.longest_gap(bins(spark, sf_dir), ["doc_id"])


BLOCKS = f"""{LINES}, p AS (SELECT *, last_value(CASE WHEN length(line) >= 4 THEN bottom END IGNORE NULLS) OVER w AS pb, last_value(CASE WHEN length(line) >= 4 THEN x0 END IGNORE NULLS) OVER w AS px
 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY top, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum((pb IS NULL OR (length(line) >= 4 AND (x0 - px BETWEEN 3 AND 40 OR top - pb >= 5)))::INT) OVER (PARTITION BY doc_id ORDER BY top, x0 ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM p)"""


@query("paragraphs", f"WITH {BLOCKS} SELECT doc_id, block, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, md5(string_agg(line, ' ' ORDER BY top, x0)) AS digest FROM b GROUP BY 1, 2")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.block_texts(layout.blocks(lines(spark, sf_dir).withColumnRenamed("line", "text"), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "block", "x0", "top", "x1", "bottom", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("line_intervals", f"""WITH {LINES}, r AS (SELECT *, max(bottom) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
g AS (SELECT *, sum((reach IS NULL OR top > reach + 0.5)::INT) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT doc_id, min(top) AS top, max(bottom) AS bottom FROM g GROUP BY doc_id, run""")
def line_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_intervals(lines(spark, sf_dir), ["doc_id"])


@query("formula_runs", f"""WITH {LINES}, f AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l WHERE length(line) % 4 < 3),
q AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY n) - 1) // 10 AS part FROM f) SELECT doc_id, min(n) AS first, max(n) AS last FROM q GROUP BY doc_id, run, part""")
def formula_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs(lines(spark, sf_dir), ["doc_id"], "n", F.length("line") % 4 < 3, 10)


BOXES = f"{LINES}, x AS (SELECT doc_id, n, top, x0, ['front', 'topleft', 'left', 'topright', 'right', 'span'][1 + (length(line) % 6)::INT] AS place, length(line) % 2 AS col FROM l)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.get(F.array(*map(F.lit, ("front", "topleft", "left", "topright", "right", "span"))), F.length("line") % 6)
    return lines(spark, sf_dir).select("doc_id", "n", "top", "x0", place.alias("place"), (F.length("line") % 2).alias("col"))


@query("reading_order", f"WITH {BOXES} SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['front', 'topleft', 'left', 'topright', 'right', 'span'], place), top, x0) - 1 AS i FROM x")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir), ["doc_id"]).select("doc_id", "n", F.col("i").cast("long").alias("i"))


@query("next_tops", f"""WITH {BOXES} SELECT doc_id, n, coalesce(min(top) OVER (PARTITION BY doc_id, col ORDER BY top RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(top) OVER (PARTITION BY doc_id ORDER BY top RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS next_top FROM x""")
def next_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.next_top(boxes(spark, sf_dir), ["doc_id"]).select("doc_id", "n", "next_top")


@query("repeated_chars", """WITH c AS (SELECT o_custkey, o_orderkey AS pos, round(o_totalprice / 9e4) AS a, o_orderstatus AS char FROM orders) SELECT o_custkey, char, min(pos) AS pos FROM c GROUP BY o_custkey, a, char""")
def repeated_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_totalprice") / 9e4).alias("x0")
    c = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), x, x.alias("x1"), F.col("o_orderstatus").alias("char"))
    return layout.first_of_repeated(c, ["o_custkey"]).select("o_custkey", "char", "pos")


@query("lines_in_boxes", f"""WITH {LINES}, x AS (SELECT doc_id, n AS box, x0 AS bx0, x1 AS bx1, top AS bt, bottom + 30 AS bb FROM l WHERE n % 7 = 0)
SELECT l.doc_id, l.n AS line, x.box FROM l JOIN x ON l.doc_id = x.doc_id AND (top + bottom) / 2 >= bt - 1.5 AND (top + bottom) / 2 <= bb + 1.5 AND x0 < bx1 AND x1 > bx0""")
def lines_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = lines(spark, sf_dir).withColumn("line", F.col("n"))
    held = all_.filter("n % 7 = 0").select("doc_id", F.col("n").alias("box"), "x0", "x1", "top", (F.col("bottom") + 30).alias("bottom"))
    return layout.lines_in_boxes(all_, held, ["doc_id"])


@query("dominant_sizes", f"""WITH {LINES}, x AS (SELECT doc_id, n AS box, x0 - 20 AS bx0, x1 AS bx1, top AS bt, bottom + 60 AS bb FROM l WHERE n % 7 = 0),
s AS (SELECT l.doc_id, x.box, round(8 + length(line) % 5 * 0.5, 1)::DOUBLE AS size, sum(greatest(length(trim(line, ' ' || chr(9) || chr(13))), 1)) AS w, min(n) AS first FROM l JOIN x ON l.doc_id = x.doc_id AND (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (top + bottom) / 2 BETWEEN bt AND bb GROUP BY 1, 2, 3),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, box ORDER BY w DESC, first) = 1) SELECT x.doc_id, x.box, coalesce(size, 0) AS size FROM x LEFT JOIN t ON x.doc_id = t.doc_id AND x.box = t.box""")
def dominant_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of most characters in boxes over lines; a line's length gives its size."""
    rows = lines(spark, sf_dir)
    boxes = rows.filter("n % 7 = 0").select("doc_id", F.col("n").alias("box"), (F.col("x0") - 20).alias("x0"), "x1", "top", (F.col("bottom") + 60).alias("bottom"))
    words = rows.withColumnsRenamed({"n": "pos", "line": "text"}).withColumn("size", 8 + F.length("text") % 5 * 0.5)
    return layout.dominant_sizes(words, boxes, ["doc_id"])


@query("ink_boxes", """SELECT vec_id, min(e[2 * i + 1]) AS x0, min(e[2 * i + 2]) AS y0, max(e[2 * i + 1]) AS x1, max(e[2 * i + 2]) AS y1 FROM (SELECT vec_id, embedding AS e, unnest(range(32)) AS i FROM embeddings) GROUP BY vec_id""")
def ink_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as strokes of 32 points."""
    found = layout.ink_box(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("points")), ["vec_id"])
    return found.select("vec_id", *[F.col(c).cast("float").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("superscripts")
def superscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", F.col("n").alias("line"), "top", "bottom", "x0", "x1")
    return layout.attached(rows.withColumn("bottom", F.col("bottom") + 14), ["doc_id"])


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as papers: a turn is a page under a numbered heading."""
    titles = F.array(*map(F.lit, ("Introduction", "Methods", "Results", "Discussion", "Conclusion", "Appendix")))
    c = table(spark, sf_dir, "conversations")
    head = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.get(titles, (F.col("turn") % 6).cast("int")), F.lit("\n"))
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(head, F.col("text")).alias("text"))


@query("sections", """WITH t AS (SELECT conv_id AS doc, turn, ['introduction', 'methods', 'results', 'discussion', 'conclusion', NULL][1 + turn % 6] AS section, text, turn % 6 = 5 AS extra FROM conversations),
g AS (SELECT *, sum((section IS NOT NULL)::INT) OVER (PARTITION BY doc ORDER BY turn) AS nth FROM t)
SELECT doc, nth::BIGINT AS nth, max(section) AS section, min(turn) AS page_start, max(turn) AS page_end, sum(length(text) + CASE WHEN extra THEN length((turn + 1)::VARCHAR) + 12 ELSE 0 END)::BIGINT AS chars FROM g GROUP BY 1, 2
HAVING sum(length(text)) >= 30""")
def sections_(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.sectioned(papers(spark, sf_dir))
    return found.select("doc", "nth", "section", "page_start", "page_end", F.length("text").cast("long").alias("chars"))


@query("outline")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.outline(papers(spark, sf_dir))


@query("page_of_offset", """WITH s AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start FROM conversations),
q AS (SELECT DISTINCT conv_id, unnest([0, 500, 1500, 4000]) AS "at" FROM conversations) SELECT q.conv_id, q."at"::BIGINT AS place, max(turn) AS page FROM q JOIN s ON s.conv_id = q.conv_id AND s.start <= q."at" GROUP BY 1, 2""")
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page an offset of the joined text falls on: the last page that starts by then."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    starts = c.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start"))
    asked = c.select("conv_id").distinct().withColumn("place", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 500, 1500, 4000)])))
    return asked.join(starts, "conv_id").filter("start <= place").groupBy("conv_id", "place").agg(F.max("turn").alias("page"))


@query("chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 1500, 2500, 120)


@query("rejoined")
def rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with overlaps put together again."""
    return chunking.reassembled(chunks(spark, sf_dir), "doc_id")


@query("snapped_cuts", f"""WITH {LINES}, r AS (SELECT *, max(bottom) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
g AS (SELECT *, sum((reach IS NULL OR top > reach + 0.5)::INT) OVER (PARTITION BY doc_id ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS run FROM r), i AS (SELECT doc_id, min(top) AS t, max(bottom) AS b FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, unnest([20.0, 45.5, 101.0])::DOUBLE AS y FROM documents) SELECT c.doc_id, c.y, CASE WHEN t IS NULL THEN c.y WHEN c.y - t <= b - c.y THEN t ELSE b END AS snapped FROM c LEFT JOIN i ON i.doc_id = c.doc_id AND c.y > t AND c.y < b""")
def snapped_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(20.0), F.lit(45.5), F.lit(101.0))).alias("y"))
    return layout.snapped(cuts, layout.merged_intervals(lines(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query("clamped_boxes", f"WITH {LINES} SELECT doc_id, n, greatest(x0 - 2, 0) AS x0, greatest(top - n // 7 * 84 - 2, 0) AS y0, least(x1 + 2, 300) AS x1, least(bottom - n // 7 * 84 + 2, 90) AS y1 FROM l")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all lines, seven to a page."""
    above = F.floor(F.col("n") / 7) * 84
    box = layout.clamped(F.array("x0", F.col("top") - above, "x1", F.col("bottom") - above), 300, 90, 2)
    rows = lines(spark, sf_dir).select("doc_id", "n", box.alias("b"))
    return rows.select("doc_id", "n", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("mathish_lines", "SELECT event_id, [false, true, true, false, true, false, true][1 + event_id % 7] AS mathish FROM events")
def mathish_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.text import mathish

    given = ("are assumed: α = 0.05 and so", "eeff ¼ 33 33 (3)", "x", "in of as", "ndm gp", "a sentence of plain words", "(cid:3) 1")
    line = F.get(F.array(*map(F.lit, given)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", mathish(line).alias("mathish"))


@query("table_regions", f"""WITH {LINES}, w AS (SELECT doc_id, n, top, bottom, CASE WHEN length(line) % 3 = 0 THEN 'the plain words of prose here' ELSE 'PZT-5 ' || (1000 + n) END AS text FROM l),
k AS (SELECT *, text LIKE 'PZT%' AS tl FROM w), a AS (SELECT *, coalesce(lag(tl) OVER v AND top - lag(bottom) OVER v <= 3, false) AS after FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY top)),
r AS (SELECT *, sum((NOT after)::INT) OVER (PARTITION BY doc_id ORDER BY top) AS run FROM a)
SELECT doc_id, min(top) AS top, max(bottom) AS bottom, count(*) AS bands FROM r WHERE tl GROUP BY doc_id, run HAVING count(*) >= 2""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.length("line") % 3 == 0, "the plain words of prose here").otherwise(F.concat(F.lit("PZT-5 "), (1000 + F.col("n")).cast("string")))
    words = lines(spark, sf_dir).select("doc_id", F.col("n").alias("band"), "top", "bottom", text.alias("text"))
    return layout.table_regions(words, ["doc_id"], gap=3.0)


@query("merged_fragments")
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("n") % 3 == 0, "start").otherwise("indent")
    rows = lines(spark, sf_dir).select("doc_id", F.col("n").alias("i"), F.lit("body").alias("kind"), (F.col("n") % 2).alias("col"), split.alias("split"), "x0", "top", "x1", "bottom", F.col("line").alias("text"))
    return layout.merged_fragments(rows, ["doc_id"])


@query("column_gaps", """WITH w AS (SELECT l_suppkey AS page, x0, x0 + 20 + l_partkey % 10 AS x1, (l_orderkey // 2 % 40 * 20)::DOUBLE AS top FROM (SELECT *, (CASE WHEN l_partkey % 97 = 0 THEN 300 ELSE 40 + l_orderkey % 2 * 300 + l_linenumber * 25 END)::DOUBLE AS x0 FROM lineitem)),
b AS (SELECT *, floor((top - 100) / 20)::INT AS band FROM w WHERE top >= 100 AND top < 800),
c AS (SELECT page, band, bin FROM (SELECT page, band, x1 - x0 AS ink, unnest(generate_series(floor(x0 / 7e2 * 120)::INT, floor(x1 / 7e2 * 120)::INT)) AS bin FROM b) GROUP BY page, band, bin HAVING sum(ink) > 0.5),
s AS (SELECT page, band, bin FROM c WHERE bin BETWEEN 18 AND 101 UNION SELECT page, band, unnest([17, 102]) FROM b),
g AS (SELECT page, band, bin + 1 AS start, lead(bin) OVER (PARTITION BY page, band ORDER BY bin) - bin - 1 AS length FROM s),
t AS (SELECT page, band, start + length / 2e0 AS m FROM g WHERE length >= 2 QUALIFY row_number() OVER (PARTITION BY page, band ORDER BY length DESC, start) = 1),
v AS (SELECT page, band, round_even(m, 0)::INT AS bin FROM b JOIN t USING (page, band) GROUP BY page, band, m HAVING count(*) >= 6 AND count(*) FILTER (x1 <= m * 7e2 / 120) >= 3 AND count(*) FILTER (x0 >= m * 7e2 / 120) >= 3),
k AS (SELECT page, bin, count(*) AS n, min(band) AS f FROM v GROUP BY page, bin QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, f) = 1)
SELECT page, bin * 7e2 / 120 AS x_mid FROM k JOIN w USING (page) WHERE n >= 3 GROUP BY page, bin HAVING count(*) FILTER (x1 <= bin * 7e2 / 120 + 1) >= 8 AND count(*) FILTER (x0 >= bin * 7e2 / 120 - 1) >= 8""")
def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words of two columns, with some in the gutter; suppliers are pages."""
    x0 = F.when(F.col("l_partkey") % 97 == 0, 300).otherwise(40 + F.col("l_orderkey") % 2 * 300 + F.col("l_linenumber") * 25).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x0.alias("x0"), (x0 + 20 + F.col("l_partkey") % 10).alias("x1"), (F.floor(F.col("l_orderkey") / 2) % 40 * 20).cast("double").alias("top"))
    return layout.column_gap(rows, ["page"], 700.0, 800.0, 100.0)


@query("heading_prefixes", "SELECT event_id, CASE WHEN event_id % 6 > 2 THEN 0 WHEN event_id // 6 % 6 = 5 THEN 2 ELSE 1 END AS n FROM events")
def heading_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ("2.1 Device Model", "IV. Results", "3 Methods", "(2) a small one", "7. It ends here.", "plain")
    second = ("and Fit", "The first of many composites reported by others", "ME", "4 Next", "Alloys-", "(continued)")
    pick = lambda of, k: F.get(F.array(*map(F.lit, of)), k.cast("int"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", T.heading_prefix(pick(first, e % 6), pick(second, F.floor(e / 6) % 6)).alias("n"))


PIECES = ("[?] a", "x = 2", "plain words of some prose", "⟦G:3⟧ 1", "other lines with prose words")


@query("broken_formulas", f"""WITH {LINES}, t AS (SELECT doc_id, n, {list(PIECES)}[1 + length(line) % 5] AS line FROM l),
k AS (SELECT *, length(line) < 10 AS f, line LIKE '%[?]%' OR line LIKE '%⟦G:%' AS u FROM t), r AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM k),
b AS (SELECT *, f AND count(*) OVER (PARTITION BY doc_id, f, run) <= 10 AND bool_or(u) OVER (PARTITION BY doc_id, f, run) AS broken, row_number() OVER (PARTITION BY doc_id, f, run ORDER BY n) AS i FROM r)
SELECT doc_id, md5(string_agg(CASE WHEN broken THEN '⟦FORMULA⟧' ELSE line END, chr(10) ORDER BY n)) AS digest, count(*) FILTER (broken) AS marked FROM b WHERE NOT broken OR i = 1 GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""")
def broken_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose lines are prose or pieces of formulas, by their lengths."""
    line = lambda s: F.get(F.array(*map(F.lit, PIECES)), F.length(s) % 5)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))
    found = formulas.without_broken_formulas(rows, "doc_id", "text")
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.regexp_count("text", F.lit("⟦FORMULA⟧")).cast("long").alias("marked"))


PARTS = ("E ¼ 4", "a sentence of plain words", "x", "3 (1)", "y = 2")


@query("formula_spans", f"""WITH {LINES}, t AS (SELECT * REPLACE ({list(PARTS)}[1 + length(line) % 5] AS line) FROM l), r AS (SELECT *, sum((line LIKE '%plain%')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM t),
s AS (SELECT doc_id, min(n) AS first, max(n) AS last, min(x0) - 2 AS x0, greatest(min(top) - 2, 0) AS y0, max(x1) + 2 AS x1, max(bottom) + 2 AS y1, count(*) AS c, bool_or(line LIKE '%¼%' OR line LIKE '%=%') AS related, arg_max(bottom, n) - arg_min(top, n) AS h FROM r WHERE line NOT LIKE '%plain%' GROUP BY doc_id, run)
SELECT doc_id, first, last, x0, y0, x1, y1, printf('⟦FORMULA:%.1f,%.1f,%.1f,%.1f⟧', x0, y0, x1, y1) AS marker FROM s WHERE c <= 12 AND related AND h <= 90""")
def formula_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, PARTS)), F.length("line") % 5)
    rows = lines(spark, sf_dir).select("doc_id", F.col("n").alias("line"), text.alias("text"), "x0", "x1", "top", "bottom")
    return formulas.formula_spans(rows, ["doc_id"])


@query("marked_symbols", f"""WITH {LINES}, t AS (SELECT *, length(line) % 4 AS k FROM l),
g AS (SELECT doc_id, 2 * n + i AS symbol, x0 + 10 * i - n % 3 * 3 AS sx0, x0 + 10 * i - n % 3 * 3 + 5 AS sx1, top + n % 5 * 4 AS st, bottom + n % 5 * 4 - 6 AS sb FROM l, (SELECT unnest([0, 1]) AS i)),
h AS (SELECT doc_id, n, list(symbol ORDER BY sx0, symbol) AS s FROM t JOIN g USING (doc_id) WHERE sx0 >= x0 - 4 AND sx1 <= x1 + 4 AND st >= top - 8 AND sb <= bottom + 8 GROUP BY doc_id, n)
SELECT doc_id, n AS line, CASE k WHEN 0 THEN 'a ' || coalesce('⟦G:' || s[1] || '⟧', '[?]') || ' b' WHEN 1 THEN '[?] x' WHEN 2 THEN 'plain' ELSE '[?] more than ' || coalesce('⟦G:' || s[3] || '⟧', '[?]') END AS text FROM t LEFT JOIN h USING (doc_id, n)""")
def marked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols about every line, some of them outside its box."""
    given = ("a (cid:7) b", "(cid:1)(cid:2) x", "plain", "(cid:3) + (cid:4) more than (cid:5)")
    all_ = lines(spark, sf_dir)
    rows = all_.select("doc_id", F.col("n").alias("line"), F.get(F.array(*map(F.lit, given)), F.length("line") % 4).alias("text"), "x0", "x1", "top", "bottom")
    i, down = F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.col("n") % 5 * 4
    x0 = F.col("x0") + 10 * F.col("i") - F.col("n") % 3 * 3
    symbols = all_.select("*", i).select("doc_id", (2 * F.col("n") + F.col("i")).alias("symbol"), x0.alias("x0"), (x0 + 5).alias("x1"), (F.col("top") + down).alias("top"), (F.col("bottom") + down - 6).alias("bottom"))
    return formulas.marked_symbols(rows, symbols, ["doc_id"])


PAGE_WORDS = 360


def page_words(rows: DataFrame) -> DataFrame:
    """Words of pages (doc_id, page, words) where they stand: two lines across, then two
    columns of five words a line, but every seventh page and the first third of every fifth in one."""
    words = rows.select("doc_id", "page", F.posexplode(F.split("words", " ")).alias("k", "text")).filter("text <> ''")
    k, page = F.col("k"), F.col("page")
    wide = (k < 20) | (page % 7 == 6) | ((page % 5 == 4) & (k < 120))
    column, row = F.when(wide, 0).otherwise(F.floor((k - 20) / 170)), F.when(wide, F.floor(k / 10)).otherwise(2 + F.floor((k - 20) % 170 / 5))
    x0 = 40 + F.when(wide, k % 10 * 52).otherwise((k - 20) % 170 % 5 * 50 + column * 270)
    top = (30 + row * 20 + F.length("text") % 2).cast("double")
    wide_as = F.least(4 * F.length("text"), F.lit(50))
    return words.select("doc_id", "page", x0.cast("double").alias("x0"), (x0 + wide_as).cast("double").alias("x1"), top.alias("top"), (top + 9).alias("bottom"), "text")


def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, words: the words of all documents on pages of 360, a page's words as one string."""
    words = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", r"\s+").alias("w"))
    pages = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PAGE_WORDS))).alias("page"))
    words = F.array_join(F.slice("w", (F.col("page") * PAGE_WORDS + 1).cast("int"), F.lit(PAGE_WORDS)), " ")
    return pages.select("doc_id", "page", words.alias("words"))


def stored_words(spark: SparkSession, sf_dir: str) -> assembly.Stored:
    return assembly.stored(packed_pages(spark, sf_dir), ["doc_id", "page"], PAGE_WORDS, page_words)


@query("page_regions")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assembly.stored_regions(stored_words(spark, sf_dir), 620.0, 800.0)
    return found.select("doc_id", "page", "i", "place", "x0", "top", "x1", "bottom", F.md5("text").alias("digest"))


@query("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = assembly.stored_texts(stored_words(spark, sf_dir), 620.0, 800.0)
    return texts.select("doc_id", "page", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(spacing.COMMON))


@query("healed_lines", f"""WITH l AS (SELECT doc_id, n, list_filter(string_split(line, ' '), lambda w: w <> '') AS w FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
g AS (SELECT doc_id, n, w, array_to_string(w, '') AS t, len(list_filter(w, lambda x: list_contains([{COMMON}], lower(trim(x, '.,;:''()[]'))))) AS hits, list_max(list_transform(w, lambda x: length(x))) AS most FROM l)
SELECT doc_id, n, md5(CASE WHEN length(t) >= 16 AND length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) >= length(t) * 0.9 AND len(w) >= 3 AND most <= 26 AND length(t) >= 3 * len(w) AND hits >= 2 THEN array_to_string(w, ' ') ELSE t END) AS digest FROM g""")
def healed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without their spaces, in characters 5 wide, words 1.4 apart."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n"), words.alias("w"), F.array_join(words, "").alias("t"))
    # before each character of a word, as many spaces as words
    before = F.flatten(F.transform("w", lambda w, k: F.array_repeat(k, F.length(w))))
    rows = rows.select("doc_id", "n", "t", before.alias("k"))
    x0 = lambda i: i * F.lit(5.0) + F.get("k", i) * F.lit(1.4)
    chars = F.when(F.col("t") != "", F.transform(F.split("t", ""), lambda c, i: F.struct(x0(i).alias("x0"), (x0(i) + 5.0).alias("x1"), F.lit(9.0).alias("size"), c.alias("char"))))
    return rows.select("doc_id", "n", F.md5(spacing.healed(F.col("t"), chars)).alias("digest"))
