"""Markup queries on pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import merge
from quire.plans.registry import query
from quire.session import table


@query("safe_html")
def safe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.safe_html(F.col("html")).alias("html"))


@query("plain_text", "SELECT event_id, 'Title: α×3² and x₁' || event_type || ' link' AS text FROM events")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit(r"## **Title**: $\alpha \times 3^{2}$ and $x_1$"), F.col("event_type"), F.lit(" [link](http://a.b)"))
    return table(spark, sf_dir, "events").select("event_id", markup.plain_text(given).alias("text"))


@query("block_output", "SELECT event_id, '0:' || event_type || ' x|2:open|5:last' AS blocks FROM events")
def block_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("⟦T5⟧first⟦/T5⟧ ⟦T0⟧"), F.col("event_type"), F.lit("\nx⟦/T0⟧⟦T2⟧open\n\n⟦T5⟧last⟦/T5⟧⟦T7⟧ "))
    blocks = markup.block_output(raw)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(blocks, lambda b: F.concat_ws(":", b["i"].cast("string"), b["text"])), "|").alias("blocks"))


@query("block_alignment", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN event_id % 2 = 0 THEN 'b c' END AS second FROM events")
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(4), F.lit(6)))
    rows = table(spark, sf_dir, "events").select("event_id", markup.paragraphs_as_blocks(F.lit("a\n\nb\nc\n\n⟦x⟧"), ids).alias("b"))
    return rows.select("event_id", F.size("b").cast("long").alias("n"), F.get("b", F.lit(1))["text"].alias("second"))


@query("recognised_symbols", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1=×,2=≈' WHEN 1 THEN '1=×,3=±' ELSE '' END AS found FROM events")
def recognised_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "1=×, 2：≈, 3=ab, 9=±").when(F.col("event_id") % 3 == 1, "×, qq, ±").otherwise("none")
    found = F.filter(markup.recognised(raw, 3, "×≈±"), lambda s: s["sym"] != "a")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(found, lambda s: F.concat_ws("=", s["i"].cast("string"), s["sym"])), ",").alias("found"))


@query("formula_boxes", "SELECT vec_id, len(list_filter([[e[1], e[2], e[3], e[4]], [e[5], e[6], e[7], e[8]], [e[9], e[10], e[11], e[12]]], lambda b: b[3] > b[1] AND b[4] > b[2])) AS n FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def formula_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    boxes = F.array(F.slice(v, 1, 4), F.slice(v, 5, 4), F.slice(v, 9, 4), F.slice(v, 1, 3), F.array(F.lit(0.0), F.lit(0.0), F.lit(float("inf")), F.lit(1.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(markup.formula_boxes(boxes)).cast("long").alias("n"))


@query("quota_errors", "SELECT event_id, event_id % 5 IN (0, 3) AS exhausted FROM events")
def quota_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ("Token Plan limit exceeded", "Too Many Requests", "429 billing tier rate limit exceeded", "quota exceeded, rpm", "quota")
    k = (F.col("event_id") % 5).cast("int")
    return table(spark, sf_dir, "events").select("event_id", markup.quota_exhausted(F.when(k == 4, 500).otherwise(429), F.get(F.array(*map(F.lit, messages)), k)).alias("exhausted"))


@query("inferred_titles", """WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: length(s) > 8)[1] AS f, source FROM documents)
SELECT doc_id, CASE WHEN length(f) < 180 THEN f ELSE 'my ' || source END AS title FROM t""")
def inferred_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", markup.inferred_title(F.col("text"), F.concat(F.lit("my_"), F.col("source"))).alias("title"))


@query("exported_translations", """SELECT user_id AS paper_id, count(*) AS pages, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS which FROM events WHERE event_id % 5 <> 0 AND value > 80 GROUP BY 1""")
def exported_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a translation from snapshots of the current version; an unknown version counts as another."""
    e = table(spark, sf_dir, "events").withColumn("version", F.when(F.col("event_id") % 5 != 0, 5))
    kept = e.filter(F.col("version").eqNullSafe(F.lit(5)) & (F.col("value") > 80)).groupBy(F.col("user_id").alias("paper_id"))
    return kept.agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: i.cast("string")), ",").alias("which"))


@query("released_files", """WITH r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity <= 2),
m AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'p/' || o_orderkey END AS path, (o_totalprice * 100)::BIGINT AS size, o_orderstatus <> 'P' AS blob FROM orders)
SELECT m.id, m.path, blob AND r.id IS NULL AS blob, CASE WHEN blob AND r.id IS NOT NULL THEN size ELSE 0 END AS freed, CASE WHEN r.id IS NOT NULL THEN '2000-01-01' END AS released_at,
 d.id IS NOT NULL AND path IS NOT NULL AS deleted, CASE WHEN d.id IS NOT NULL AND path IS NOT NULL THEN 'me' END AS propagate_by, CASE WHEN d.id IS NULL THEN '' WHEN path IS NULL THEN 'pathless' ELSE 'marked' END AS outcome
FROM m LEFT JOIN r ON r.id = m.id LEFT JOIN d ON d.id = m.id""")
def released_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shared files: those with returned items are released, those with
    items of a small quantity deleted on the other devices too."""
    none, no, now = F.lit(None).cast("string"), F.lit(False), F.lit("2000-01-01")
    k, items = F.col("o_orderkey"), table(spark, sf_dir, "lineitem")
    path = F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("p/"), k.cast("string")))
    state = (none.alias("released_at"), no.alias("deleted"), no.alias("propagate"), none.alias("propagate_by"), none.alias("deleted_at"))
    shared = table(spark, sf_dir, "orders").select(k.alias("id"), path.alias("path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), (F.col("o_orderstatus") != "P").alias("blob"), *state)
    asked = items.filter("l_quantity <= 2").select(F.col("l_orderkey").alias("id"))
    after = merge.propagated(merge.released(shared, items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), now), asked, "me", now)
    rows = after.join(merge.propagation(shared, asked), "id", "left")
    return rows.select("id", "path", "blob", "freed", "released_at", "deleted", "propagate_by", F.coalesce("outcome", F.lit("")).alias("outcome"))


ALLOWED = ("src1", "src2", "src0")


@query("listed_categories", """SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source END AS strict, CASE WHEN source IN ('src0', 'src1', 'src2') THEN NULL ELSE 'unknown category: ' || coalesce(source, '') || '; allowed: src1, src2, src0' END AS error,
 CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'src1' END AS filled FROM documents""")
def listed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents held against a list: refused, or the first of it instead."""
    strict, filled = (markup.listed_category(F.col("source"), ALLOWED, f) for f in (False, True))
    return table(spark, sf_dir, "documents").select("doc_id", strict["value"].alias("strict"), strict["error"].alias("error"), filled["value"].alias("filled"))


@query("abstract_sources", """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<article><h1>[^<]*</h1><p>(.*?)</p>', 1) AS own, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad FROM pages),
c AS (SELECT *, trim(regexp_replace(regexp_replace(own, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM p)
SELECT page_id, CASE WHEN clean <> '' THEN clean WHEN title <> '' THEN title ELSE coalesce(ad, '') END AS text, CASE WHEN clean <> '' THEN 'article' WHEN title <> '' THEN 'article+title' WHEN ad <> '' THEN 'article+ad' ELSE 'article' END AS source FROM c""")
def abstract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph of a page's article, else its title, else a note beside it."""
    part = lambda rule: F.regexp_extract("html", rule, 1)
    found = markup.first_abstract([("article", part(r"(?s)<article><h1>[^<]*</h1><p>(.*?)</p>")), ("title", part(r"<title>([^<]*)</title>")), ("ad", part(r'<div class="ad">([^<]*)</div>'))])
    return table(spark, sf_dir, "pages").select("page_id", found["text"].alias("text"), found["source"].alias("source"))


@query("block_signatures", "SELECT conv_id, 'v1' || chr(10) || string_agg(turn || ':' || trim(text, ' ' || chr(10)), chr(10) ORDER BY turn) AS signature FROM conversations GROUP BY conv_id")
def block_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("i"), "text"))).alias("b"))
    return blocks.select("conv_id", markup.block_signature(F.col("b"), 1).alias("signature"))


@query("checked_markers", "SELECT event_id, 'a ⟦TABLE:1.0,2.0,' || (event_id % 9 + 3) || '.0,4.2⟧ b [FORMULA]' || event_type AS text FROM events")
def checked_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("a ⟦TABLE:1, 2,"), (F.col("event_id") % 9 + 3).cast("string"), F.lit(",4.24⟧ b ⟦FORMULA:5,1,2,x⟧"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", markup.checked_markers(given).alias("text"))


@query("first_translations", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 > 0 THEN 'local' WHEN event_id % 5 > 0 THEN 'cloud' ELSE 'seed' END AS text FROM events")
def first_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local, cloud or baked-in translations, each behind its own version."""
    k = F.col("event_id")
    version = F.when(k % 3 > 0, 5)
    sources = [(F.lit("local"), version, k % 2 == 0), (F.when(k % 5 > 0, "cloud").otherwise(""), F.lit(5), F.lit(True)), (F.lit("seed"), F.lit(5), F.lit(True))]
    return table(spark, sf_dir, "events").select("event_id", markup.first_translation(sources, 5).alias("text"))


@query("rate_profiles", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 11 ELSE 30 END AS rpm FROM events")
def rate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(F.lit("AGNES-2"), F.lit("other"), F.lit(None).cast("string")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", markup.rate_profile(model).alias("rpm"))


@query("filled_blocks", "SELECT event_id, event_type || '|' || '（未翻译）' AS texts, 'partial' AS reason FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, '（未翻译）|（未翻译）', 'parse' FROM events WHERE event_id % 3 = 0")
def filled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda i, kind: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.lit("x").alias("text"))
    blocks = F.array(block(0, "body"), block(1, "formula"), block(2, "heading"))
    got = F.when(F.col("event_id") % 3 > 0, F.array(F.struct(F.lit(0).alias("i"), F.col("event_type").alias("text")))).otherwise(F.array().cast("array<struct<i:int,text:string>>"))
    rows = table(spark, sf_dir, "events").withColumn("got", got).withColumn("b", markup.filled_blocks(blocks, F.col("got")))
    texts = F.array_join(F.transform("b", lambda b: b["translation"]), "|")
    return rows.select("event_id", texts.alias("texts"), markup.fill_reason(F.col("b"), F.col("got")).alias("reason"))


@query("trimmed_pages", "SELECT event_id, ['One. Two ⟦TABLE:1.5,2⟧', 'Done.', 'no end at all', 'A! ⟦FORMULA:1.1,2.2⟧ more.'][1 + event_id % 4] AS text FROM events")
def trimmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.text import trimmed_tail

    pages = ("One. Two ⟦TABLE:1.5,2⟧ and so mag-\n 12 \n3", "Done. The rest of", "no end at all\n7", "A! ⟦FORMULA:1.1,2.2⟧ more. tail ⟦x")
    page = F.get(F.array(*map(F.lit, pages)), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", trimmed_tail(page).alias("text"))


@query("latex_repairs", r"""SELECT event_id, 'x_{' || event_type || '} 3/cm \alpha' AS repaired, 'so $\alpha_{\mathrm{' || event_type || '}}$ and $\beta$ x \nope' AS wrapped FROM events""")
def latex_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    given = F.concat(F.lit(r"x_\{"), kind, F.lit(r"\} 3\/cm \/alpha"))
    bare = F.concat(F.lit(r"so \alpha_{\mathrm{"), kind, F.lit(r"}} and \beta x \nope"))
    return table(spark, sf_dir, "events").select("event_id", markup.unescaped_latex(given).alias("repaired"), markup.wrapped_latex(bare).alias("wrapped"))


@query("extracted_math", "SELECT event_id, 'a @@MATH0@@ `$no$` @@MATH1@@ ' || event_type || ' @@MATH2@@ $5' AS text, 'x:false|' || chr(10) || event_type || ' ' || chr(10) || 'z:true|y:false' AS formulas FROM events")
def extracted_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = markup.extracted_math(F.concat(F.lit("a $x$ `$no$` $$\n"), kind, F.lit(" \nz$$ "), kind, F.lit(" $$y$$ $5")))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("f"))
    return rows.select("event_id", "f.text", F.array_join(F.transform("f.formulas", lambda m: F.concat_ws(":", m["tex"], m["display"].cast("string"))), "|").alias("formulas"))


@query("sanitized_translations", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'a $x$ ' || event_type || chr(10) || 'b' WHEN 1 THEN 'end $$y' || event_id || '$$ `$USER` c' WHEN 2 THEN event_type
 WHEN 3 THEN 'at ⟦FORMULA:1.0,2.0,' || CASE WHEN event_id % 2 = 0 THEN '3' ELSE '4' END || '.0,9.5⟧ ok' WHEN 4 THEN 'x 【公式未能完整提取：PDF 排版导致分子/分母与上下标被打散，请对照左侧 PDF 原文】 y【表格未能读出，请对照左侧 PDF 原文】'
 WHEN 5 THEN '$\\alpha$ and $\\beta$ ' || event_type ELSE 'costs ＄' || event_id END AS text FROM events""")
def sanitized_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model with leaked thoughts, other delimiters, code, markers and lone dollar signs."""
    k, kind, i = F.col("event_id") % 7, F.col("event_type"), F.col("event_id").cast("string")
    wide = F.when(F.col("event_id") % 2 == 0, "3").otherwise("4")
    given = F.when(k == 0, F.concat(F.lit("<think>why</think>a \\(x\\) "), kind, F.lit("\r\nb"))).when(k == 1, F.concat(F.lit("end \\[y"), i, F.lit("\\] `$USER` c")))
    given = given.when(k == 2, F.concat(kind, F.lit(" <think>open"))).when(k == 3, F.concat(F.lit("at ⟦FORMULA:1, 2,"), wide, F.lit(" ,9.5⟧ ok"))).when(k == 4, "x ⟦FORMULA:4,4,2,9⟧ y⟦TABLE:1⟧")
    given = given.when(k == 5, F.concat(F.lit("\\alpha and $\\beta$ "), kind)).otherwise(F.concat(F.lit("costs $"), i))
    return table(spark, sf_dir, "events").select("event_id", markup.sanitized_translation(given).alias("text"))


@query("error_messages", """WITH e AS (SELECT event_id, [401, 403, 404, 400, 503, 418, 429, 429][1 + event_id % 8] AS code, event_id % 8 AS k, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'open [PATH] failed' WHEN event_id % 11 = 1 THEN '模型输出被长度限制截断了，回答不完整。换个模型，或缩小范围（少看上下文）再试。' ELSE CASE WHEN event_id % 3 = 0 THEN event_type || '：' ELSE '' END ||
 CASE k WHEN 0 THEN '鉴权失败（HTTP 401）：API Key 无效或没有权限，检查 .env 里的 LLM_API_KEY / AGNES_API_KEY。' WHEN 1 THEN '鉴权被拒（HTTP 403）：API Key 没有这个模型的权限，换一个 key 或模型。' WHEN 2 THEN '接口或模型不存在（HTTP 404）：检查 .env 里的 base_url 和模型名是否写错。'
 WHEN 3 THEN '请求被上游拒绝（HTTP 400）：模型名或参数不对，检查 .env 里的模型配置。' WHEN 4 THEN '上游模型服务暂时不可用（HTTP ' || code || '）：稍后重试；一直失败就换个模型。' WHEN 5 THEN '模型接口返回错误（HTTP ' || code || '）。'
 WHEN 6 THEN '模型额度用完了（HTTP 429 · 配额耗尽）：套餐/余额额度已用尽，现在重试也一样。等额度恢复再试，或在 .env 里配一个你自己的模型。' ELSE '请求太频繁（HTTP 429 · 限流）：刚发出的请求超过了该模型的每分钟上限。等几十秒再试，或换一个模型/拉长间隔。' END END AS told FROM e""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of all kinds, with and without a context before the status."""
    i, kind = F.col("event_id"), F.col("event_type")
    code = F.get(F.array(*[F.lit(c) for c in (401, 403, 404, 400, 503, 418, 429, 429)]), (i % 8).cast("int")).cast("string")
    body = F.when(i % 8 == 6, "quota exceeded").when(i % 8 == 7, "Too Many Requests").otherwise("no")
    given = F.concat(F.when(i % 3 == 0, F.concat(kind, F.lit(": "))).otherwise(""), F.lit("HTTP "), code, F.lit(": "), body)
    given = F.when(i % 11 == 0, "open /home/me/x.txt failed").when(i % 11 == 1, "__MARK__: 译文不完整").otherwise(given)
    return table(spark, sf_dir, "events").select("event_id", markup.error_message(given).alias("told"))


@query("font_texts", """SELECT doc_id, sha256(regexp_replace(replace(replace(translate(t, chr(10) || chr(13) || chr(9) || '—₂²', '   -2'), '⇒', '=>'), '꜀', '_C'), '[^ -~]', '', 'g')) AS digest
FROM (SELECT doc_id, text || ' T꜀ ⇒ 5—6 H₂O, x² 漢' || chr(9) AS t FROM documents)""")
def font_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and some signs in a font of printable ASCII."""
    text = F.concat(F.col("text"), F.lit(" T꜀ ⇒ 5—6 H₂O, x² 漢\t"))
    shown = F.when(text.isNotNull(), markup.in_font(text, [(0x20, 0x7E)]))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(shown.cast("binary"), 256).alias("digest"))
