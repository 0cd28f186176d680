"""Retrieval and text queries: documents stand in for notes, their source for
the title, their language for the tags; conversations for sections of a paper."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import identity
from quire.functions import text as T
from quire.operators import retrieval
from quire.plans.registry import query
from quire.session import table
from quire.sources import gram_index
from quire.sources.tables import shared_dir

WORDS = ["the", "tion", "lich"]
COUNT = "((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // length('{w}'))"
SCORE = " + ".join(f"CASE WHEN contains(source, '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(lang, '{w}') THEN 5 ELSE 0 END + 2 * least({COUNT.format(w=w)}, 10)" for w in ["src1", *WORDS])
FIRST = "list_min(list_filter([" + ", ".join(f"instr(lower(text), '{w}')" for w in ["src1", *WORDS]) + "], lambda p: p > 0)) - 1"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("source").alias("title"), F.col("lang").alias("tags"), F.lit("").alias("category"), F.col("text").alias("body"))


@query("search_notes", f"""WITH s AS (SELECT 'd' || lpad(doc_id::VARCHAR, 12, '0') AS path, source AS title, lang AS tags, ({SCORE})::INT AS score, text, {FIRST} AS f FROM documents),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, path DESC LIMIT 20),
c AS (SELECT *, greatest(f - 200, 0) AS a, least(length(text), f + 200) AS b FROM t)
SELECT path, title, tags, score, left(regexp_replace(CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(text, a + 1, b - a), chr(10) || ' ') || CASE WHEN b < length(text) THEN '...' ELSE '' END, '\\n{{2,}}', chr(10), 'g'), 400) AS snippet FROM c""")
def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(notes(spark, sf_dir), "src1 the tion lich", top_k=20)


#: Of the asked words the rarer ones are in some notes only; one is of two characters.
ASKED = ("src1 the tion lich", "zation ungen", "qu xyz")


def _asked_sql(question: str) -> str:
    words = question.split()
    score = " + ".join(f"CASE WHEN contains(source, '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(lang, '{w}') THEN 5 ELSE 0 END + 2 * least({COUNT.format(w=w)}, 10)" for w in words)
    score += " + " + " + ".join(f"4 * len(list_filter(regexp_extract_all(text, '(?m)^#{{1,3}}\\s+(.+)$', 1), lambda h: contains(lower(h), '{w}')))" for w in words)
    return f"(SELECT '{question}' AS question, 'd' || lpad(doc_id::VARCHAR, 12, '0') AS path, ({score})::INT AS score FROM documents WHERE score > 0 ORDER BY score DESC, path DESC LIMIT 20)"


@query("indexed_search", " UNION ALL ".join(map(_asked_sql, ASKED)))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best notes of several questions from a stored gram index of all documents."""
    root = f"{shared_dir(spark)}/gram-index-{uuid.uuid4().hex}"
    gram_index.add(notes(spark, sf_dir), root, buckets=64)
    found = [gram_index.search(spark, root, q, top_k=20).select(F.lit(q).alias("question"), "path", "score") for q in ASKED]
    return reduce(DataFrame.unionAll, found)


@query("note_page", "SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE source <> 'src3' ORDER BY doc_id DESC LIMIT 20 OFFSET 40")
def note_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing with the total after filtering; filters come first."""
    kept = docs(spark, sf_dir).filter("source <> 'src3'").select("doc_id", "source", "n_chars")
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(F.desc("doc_id")).offset(40).limit(20).join(F.broadcast(total))  # a single row


@query("ordinals", """WITH q AS (SELECT conv_id, turn, ['第22节讲了什么', '总结一下第四章', 'Section IV 说了什么', 'section 7 please', '这一节讲了什么', '第十二章', 'chapter XL and part 3'][1 + conv_id % 7] AS question FROM conversations)
SELECT conv_id, turn, ['22', '4', '4', '7', '', '12', '3,40'][1 + conv_id % 7] AS numbers FROM q""")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ("第22节讲了什么", "总结一下第四章", "Section IV 说了什么", "section 7 please", "这一节讲了什么", "第十二章", "chapter XL and part 3")
    c = table(spark, sf_dir, "conversations")
    found = T.ordinals(F.get(F.array(*map(F.lit, asked)), (F.col("conv_id") % 7).cast("int")))
    return c.select("conv_id", "turn", F.array_join(F.transform(found, lambda n: n.cast("string")), ",").alias("numbers"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("keywords", f"""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')), lambda w: w NOT IN ({STOPS}))), ' ') AS words FROM benchmark""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(T.keywords(F.col("text"))), " ").alias("words"))


@query("section_scores", f"""WITH q AS (SELECT ['the', 'and', 'that', 'tion'] AS w), s AS (SELECT conv_id, turn, lower(left(text, 500)) AS body FROM conversations)
SELECT conv_id, turn, ((CASE WHEN turn = 1 THEN 60 ELSE 0 END) + (CASE WHEN contains(body, 'tion') THEN 1 ELSE 0 END) + (CASE WHEN contains(body, 'ering') THEN 1 ELSE 0 END))::INT AS score FROM s""")
def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sections; the question names section 2 and two words."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("pos"), F.lit("").alias("number"), F.lit("").alias("title"), F.col("role").alias("section"), "text")
    return retrieval.section_scores(c, "section 2 tion ering").select(F.col("doc").alias("conv_id"), F.col("pos").cast("long").alias("turn"), "score")


@query("packed_context")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("pos"), F.lit("").alias("number"), F.lit("").alias("title"), F.col("role").alias("section"), "text")
    return retrieval.packed_context(retrieval.section_scores(c, "section 2 tion ering"), 0, 2400, 1200, 800, least=200)


@query("cross_section_context", """SELECT conv_id, string_agg('[' || role || ']' || chr(10) || CASE WHEN length(text) <= 200 THEN text ELSE left(text, 100) || '…' || right(text, 100) END, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def cross_section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), T.head_tail(F.col("text"), 200, "…"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("context"))


@query("head_tail", "SELECT doc_id, CASE WHEN length(text) <= 501 THEN text ELSE left(text, 250) || ' … ' || right(text, 251) END AS clip FROM documents")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.head_tail(F.col("text"), 501, " … ").alias("clip"))


@query("clipped", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 260) || chr(10) || '…[' || (length(text) - 400) || ']…' || chr(10) || right(text, 140) END AS clip FROM documents")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clipped(F.col("text"), 400).alias("clip"))


@query("untranslated", """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*(?:[ \\t]+[A-Za-z][A-Za-z''-]*){7,}')) AS run FROM documents)
SELECT doc_id, count(*) AS runs, sum(length(run))::BIGINT AS chars FROM r WHERE NOT regexp_matches(run, '(?i)https?|www|\\bdoi\\b|\\bfig\\b|\\beq\\b')
 AND NOT regexp_full_match(run, '(?:(?:[A-Z][A-Za-z''-]*|[A-Za-z''-]{1,2})(?:[ \\t]+|$))+') GROUP BY doc_id""")
def untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untranslated_in(docs(spark, sf_dir))


def untranslated_in(d: DataFrame) -> DataFrame:
    runs = d.select("doc_id", T.untranslated_runs(F.col("text")).alias("r")).filter(F.size("r") > 0)
    return runs.select("doc_id", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda n, r: n + F.length(r)).alias("chars"))


@query("redacted_secrets", """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bsk-[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), '(?i)\\b(bearer|basic)\\s+[A-Za-z0-9._~+/=-]{8,}', '\\1 [REDACTED]', 'g'),
 '(?i)\\b(api[_-]?key|token|secret|password|passwd)(["'']?\\s*[:=]\\s*["'']?)[^\\s"''&,;]{4,}', '\\1\\2[REDACTED]', 'g'), '(?i)(https?://)[^\\s/@:]+:[^\\s/@]+@', '\\1[REDACTED]@', 'g')) AS digest FROM documents""")
def redacted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.redacted_secrets(F.col("text")).cast("binary")).alias("digest"))


@query("masked_paths", r"""WITH g AS (SELECT event_id, 'open /home/' || event_type || '/x.txt C:\Users\a see https://h.org/tmp/y' AS t FROM events),
w AS (SELECT event_id, regexp_replace(t, '(^|[^A-Za-z0-9])[A-Za-z]:\\[^\s"''<>|]+', '\1[PATH]', 'g') AS t FROM g)
SELECT event_id, regexp_replace(t, '(^|[^A-Za-z0-9:/.])/(home|Users|root|tmp|var|opt|etc|mnt)/[^\s"''<>|]+', '\1[PATH]', 'g') AS text FROM w""")
def masked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("open /home/"), F.col("event_type"), F.lit("/x.txt C:\\Users\\a see https://h.org/tmp/y"))
    return table(spark, sf_dir, "events").select("event_id", T.masked_paths(given).alias("text"))


@query("without_thoughts", """SELECT conv_id, turn, trim(CASE conv_id % 4 WHEN 3 THEN '' ELSE text END, chr(10) || ' ') AS text FROM conversations""")
def without_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("conv_id") % 4
    given = F.when(k == 0, F.concat(F.lit("<think>a\nb</think>"), t)).when(k == 1, F.concat(F.lit("x</think>\n"), t)).when(k == 2, F.concat(t, F.lit("<thinking>open"))).otherwise(F.concat(F.lit("<think>"), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_thoughts(given).alias("text"))


@query("even_dollars", """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'a $x$ b' || chr(10) || 'c ＄' || item_id ELSE '$' || item_id || '$' END AS text FROM benchmark""")
def even_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    given = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a $x$ b\nc $"), i)).otherwise(F.concat(F.lit("$"), i, F.lit("$")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.even_dollars(given).alias("text"))


@query("one_line", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS digest FROM pages")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.one_line(F.col("html")).cast("binary")).alias("digest"))


@query("salvaged_json", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS json FROM events")
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("no {"), F.left("props", F.lit(4)))).otherwise(F.concat(F.lit("<think>{</think>Here:\n```json\n"), F.col("props"), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(given).alias("json"))


@query("front_matter", """SELECT page_id, url AS title, 'b' AS tags FROM pages""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit('---\nTitle: "'), F.col("url"), F.lit("\"\ntags: a\ntags: 'b'\nno colon\n---\n# body: x"))
    m = table(spark, sf_dir, "pages").select("page_id", T.front_matter(given).alias("m"))
    return m.select("page_id", F.col("m")["title"].alias("title"), F.col("m")["tags"].alias("tags"))


@query("first_heading", "SELECT page_id, url AS heading FROM pages")
def first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("text\n### deep\n## "), F.col("url"), F.lit(" \n# later"))
    return table(spark, sf_dir, "pages").select("page_id", T.first_heading(given).alias("heading"))


@query("safe_urls", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url ELSE '#' END AS href, page_id % 4 = 0 AND regexp_matches(url, '^https?://') AS public FROM pages""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id") % 4, F.col("url")
    given = F.when(k == 0, u).when(k == 1, F.concat(F.lit("java\tscript:"), u)).when(k == 2, F.concat(F.lit("//"), u)).otherwise("data:text/html,x")
    public = F.when(k == 0, u).when(k == 1, "http://127.0.0.1/a").when(k == 2, "http://10.1.2.3/").otherwise("ftp://a.org/")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_url(given).alias("href"), T.public_url(public).alias("public"))


@query("sentences", r"SELECT conv_id, turn, len(regexp_extract_all(text, '[.!?。！？][ \t\n\r]+')) + 1 AS pieces FROM conversations")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.sentences(F.col("text"))).cast("long").alias("pieces"))


@query("section_keys", """SELECT page_id, ['introduction', 'methods', 'results', 'conclusion', NULL, 'results', 'introduction', 'methods'][1 + page_id % 8] AS section FROM pages""")
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = ("1. Introduction", "II. METHODOLOGY", "Results.", "Summary and Outlook", "Appendix", "Experimental Results", "Background and Overview", "Methods and Materials")
    # `summary` comes before `summary and outlook` as a whole word, but equality goes first
    return table(spark, sf_dir, "pages").select("page_id", T.section_of(F.get(F.array(*map(F.lit, titles)), (F.col("page_id") % 8).cast("int"))).alias("section"))


@query("outline_titles", """SELECT event_id, ['Introduction', NULL, 'Individual Phases in ME', NULL, 'Preliminaries', NULL][1 + event_id % 6] AS title, CASE WHEN event_id % 6 IN (0) THEN 1 WHEN event_id % 6 IN (2, 4) THEN 2 END AS level FROM events""")
def outline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ("I. Introduction", "3 Measurements were performed on the samples", "(1) Individual Phases in ME", "31 ME", "A. Preliminaries", "2. M. Laletin et al")
    line = F.get(F.array(*map(F.lit, lines)), (F.col("event_id") % 6).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line")).withColumn("title", T.outline_title(F.col("line")))
    return rows.select("event_id", "title", F.when(F.col("title").isNotNull(), T.outline_level(F.col("line"))).alias("level"))


@query("unknown_glyphs", "SELECT event_id, 'a [?] b [?]' || event_type AS text FROM events")
def unknown_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("a (cid:3)(cid:14) (cid:5) b (cid:"), (F.col("event_id") % 90).cast("string"), F.lit(")"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.unknown_glyphs(given).alias("text"))


@query("token_budgets", """SELECT doc_id, least(greatest(floor(n_chars * 16 / 10e0), 4000), 16000)::BIGINT AS low, least(greatest(least(n_chars, 80000), 300), CASE lang WHEN 'en' THEN 2000 WHEN 'de' THEN 8000 ELSE 50000 END)::BIGINT AS n FROM documents""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets_of(docs(spark, sf_dir))


def budgets_of(d: DataFrame) -> DataFrame:
    mode = F.when(F.col("lang") == "en", "term").when(F.col("lang") == "de", "mid").otherwise("full")
    return d.select("doc_id", T.token_budget(F.col("n_chars"), F.lit(False)).cast("long").alias("low"), T.scope_budget(F.col("n_chars"), mode).cast("long").alias("n"))


@query("paper_ids", """WITH c AS (SELECT page_id, url, list_reduce([5381::BIGINT] || list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (a * 33 + c) % 4294967296) AS n FROM pages)
SELECT page_id, left(string_split(url, '/')[-1], 70) || CASE WHEN string_split(url, '/')[-1] = '' THEN 'paper' ELSE '' END || '_' || ltrim(array_to_string(list_transform([6,5,4,3,2,1,0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + ((n // (36 ** i)::BIGINT) % 36)::INT, 1)), ''), '0') AS paper_id FROM c""")
def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", identity.paper_id(F.col("url")).alias("paper_id"))


@query("file_names", r"""SELECT page_id, left(rtrim(trim(regexp_replace(regexp_replace(url, '[\\/*?:"<>|]', '', 'g'), '\s+', '_', 'g'), '_'), '. '), 80) AS name, left(regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g'), 128) AS key,
 string_split(url, '/')[1] IN ('01_Literature') AS inside FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", identity.file_name(u).alias("name"), identity.file_key(u).alias("key"), identity.in_vault(u).alias("inside"))


@query("fingerprint", "SELECT source, count(*) AS n, md5(string_agg(doc_id || ':' || n_chars, '|' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap fingerprint of a listing, by folder."""
    part = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    rows = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", part.alias("p")))).alias("l"))
    return rows.select("source", "n", F.md5(F.array_join(F.transform("l", lambda s: s["p"]), "|").cast("binary")).alias("digest"))


@query("content_keys", "SELECT doc_id, left(sha256(text), 16) AS key FROM documents")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16)).alias("key"))


@query("reference_ids", """SELECT event_id, '2101.' || lpad((event_id % 100000)::VARCHAR, 5, '0') AS arxiv, '10.1000/' || event_type || '.' || user_id AS doi FROM events""")
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0")
    arxiv = F.concat(F.lit("see https://arxiv.org/abs/2101."), number, F.lit("v2"))
    doi = F.concat(F.lit("https://doi.org/10.1000/"), F.upper("event_type"), F.lit("."), F.col("user_id").cast("string"), F.lit("). Next"))
    return table(spark, sf_dir, "events").select("event_id", T.arxiv_id(arxiv).alias("arxiv"), T.doi(doi).alias("doi"))


@query("streamed_text", "SELECT event_id, event_type || '!' AS text FROM events")
def streamed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('data: {"content": "'), F.col("event_type"), F.lit('"}\n\n: ping\ndata: {broken\n\ndata: {"content": "!"}\n\ndata: [DONE]\n'))
    return table(spark, sf_dir, "events").select("event_id", T.streamed_text(body).alias("text"))


@query("yaml_quoted", """SELECT page_id, '"' || url || '\\"x\\" \\\\  y"' AS quoted FROM pages""")
def yaml_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.yaml_quoted(F.concat("url", F.lit('"x" \\\n y'))).alias("quoted"))


@query("markdown_tables", "SELECT page_id, page_id % 2 = 0 AS is_table, 'a | b | c' AS bare FROM pages")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("page_id") % 2 == 0, "a | b | c").otherwise("a | b")
    return table(spark, sf_dir, "pages").select("page_id", T.is_table(t).alias("is_table"), T.without_fence(F.lit("```md\na | b | c\n```")).alias("bare"))
