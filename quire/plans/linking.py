"""Linking queries: pages stand in for files, their addresses for titles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import linking
from quire.plans.registry import query
from quire.session import table

NORM = "lower(regexp_replace({c}, '[^a-zA-Z0-9一-龥]', '', 'g'))"
MATCH = f"""WITH f AS (SELECT page_id AS file, {NORM.format(c="regexp_extract(url, 'https?://([^?]*)', 1)")} AS s FROM pages),
t AS (SELECT page_id AS id, {NORM.format(c="regexp_extract(url, 'https?://[^.]*(.*)', 1)")} AS t,
 list_filter(list_transform(regexp_split_to_array(regexp_extract(url, 'https?://[^.]*(.*)', 1), '\\W+'), lambda w: {NORM.format(c='w')}), lambda w: length(w) >= 3)[1:8] AS words FROM pages),
p AS (SELECT id, file, CASE WHEN contains(s, left(t, 18)) OR contains(t, s) THEN 70 WHEN contains(s, left(t, 10)) THEN 45 ELSE 0 END AS base, len(list_filter(words, lambda w: contains(s, w))) AS hits, len(words) AS n FROM t, f WHERE t <> '' AND s <> ''),
c AS (SELECT id, file, (base + CASE WHEN hits >= 3 THEN 25 + hits * 10 WHEN hits = 2 THEN {{two}} WHEN hits = 1 AND n <= 2 THEN {{one}} ELSE 0 END)::INT AS score FROM p)
SELECT id, file, score FROM c WHERE score >= {{least}} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, file) = 1"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every page as a title and as a file."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("url", "https?://[^.]*(.*)", 1).alias("title")), p.select(F.col("page_id").alias("file"), F.regexp_extract("url", r"https?://([^?]*)", 1).alias("stem"))


@query("title_links", MATCH.format(two=20, one=0, least=70))
def title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.title_matches(*sides(spark, sf_dir), linking.STRICT)


@query("title_search", MATCH.format(two=45, one=35, least=45))
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.title_matches(*sides(spark, sf_dir), linking.LENIENT)


@query("note_files", "SELECT o_orderkey AS path, 'lib/' || o_custkey || '.pdf' AS file FROM orders")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes that name their customer's file, by path, name or stem."""
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey").cast("string")
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see [[lib\\"), c, F.lit(".pdf]]"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("[[any/"), c, F.lit(".pdf]] [["), c, F.lit("]]"))).otherwise(F.concat(F.lit("[["), c, F.lit("]] [[none]]")))
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    files = k.select(F.explode(F.array(F.concat(F.lit("lib/"), "k", F.lit(".pdf")), F.concat(F.lit("old/"), "k", F.lit(".pdf")))).alias("file"))
    return linking.note_files(o.select(F.col("o_orderkey").alias("path"), body.alias("body")), files, r"\[\[([^\]]+)\]\]")


@query("wiki_links", """WITH t AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'd' END || c_custkey AS title, c_custkey AS path FROM customer)
SELECT o_orderkey AS path, 0 AS pos, 'c' || o_custkey AS target, t.path AS found FROM orders LEFT JOIN t ON title = 'c' || o_custkey""")
def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to titles of all customers, half of which have another title."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("a [[c"), F.col("o_custkey").cast("string"), F.lit("|name]] b")).alias("body"))
    mark = F.when(F.col("c_custkey") % 2 == 0, "c").otherwise("d")
    titles = table(spark, sf_dir, "customer").select(F.concat(mark, F.col("c_custkey").cast("string")).alias("title"), F.col("c_custkey").alias("path"))
    return linking.linked_titles(notes, titles)


BITS = "list_transform({c}[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of an embedding, four times over, as a 256-bit fingerprint."""
    bits = F.array_join(F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    words = F.concat(*[F.lpad(F.conv(F.substring(bits, 1 + 32 * i, 32), 2, 16), 8, "0") for i in range(2)])
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.repeat(words, F.lit(4)).alias("shape"))


@query("resolved_glyphs", f"""WITH b AS (SELECT vec_id, label, {BITS.format(c='embedding')} AS bits FROM embeddings), d AS (SELECT label, arg_min(bits, vec_id) AS known FROM b GROUP BY label)
SELECT vec_id, CASE WHEN 4 * list_sum(list_transform(list_zip(bits, known), lambda z: abs(z[1] - z[2]))) <= 96 THEN 'g' || b.label END AS sym FROM b JOIN d USING (label)""")
def resolved_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = shapes(spark, sf_dir).withColumn("key", F.concat(F.lit("s:F|"), F.col("label").cast("string")))
    known = seen.groupBy("key").agg(F.min_by("shape", "vec_id").alias("shape"), F.concat(F.lit("g"), F.first("label").cast("string")).alias("sym"))
    return linking.resolved_glyphs(seen, known).select("vec_id", "sym")


@query("glyph_counts", "SELECT count(*) AS instances, count(DISTINCT label) AS keys FROM embeddings")
def glyph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("label").alias("keys"))
