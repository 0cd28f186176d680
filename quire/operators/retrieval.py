"""Keyword search with field weights and snippets; section scoring; context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

TITLE, TAGS, CATEGORY, HEADING, HIT, MOST_HITS = 10, 5, 3, 4, 2, 10


def snippet(body: Column, words: list[str], limit: int) -> Column:
    """What surrounds the earliest word; else the first line that isn't a heading."""
    at = [F.instr(F.lower(body), w) for w in words]
    first = F.array_min(F.filter(F.array(*at), lambda p: p > 0)) - 1
    start = F.greatest(first - limit // 2, F.lit(0))
    end = F.least(F.length(body), first + limit // 2)
    cut = F.btrim(F.substring(body, start + 1, end - start), F.lit(T.BLANK))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(body), "...").otherwise(""))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: F.btrim(s, F.lit(T.BLANK))), lambda s: (s != "") & ~s.startswith("#"))
    return F.left(F.when(first.isNotNull(), F.regexp_replace(cut, "\n{2,}", "\n")).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), F.lit(limit))


def search(notes: DataFrame, question: str, top_k: int = 5, snippet_chars: int = 400) -> DataFrame:
    """path, title, tags, score, snippet of the best notes (path, title, tags,
    category, body), ties to the greater path. One pass, no shuffle but the
    top k of each task; the snippet is cut for those alone."""
    words = [w.lower() for w in question.split()]
    if not words:
        return notes.select("path", "title", "tags", F.lit(0).alias("score"), F.lit("").alias("snippet")).limit(0)
    field = lambda c: F.lower(F.coalesce(c, F.lit("")))
    headings = F.regexp_extract_all("body", F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    score = F.lit(0)
    for w in map(F.lit, words):
        for name, weight in (("title", TITLE), ("tags", TAGS), ("category", CATEGORY)):
            score = score + F.when(F.contains(field(F.col(name)), w), weight).otherwise(0)
        score = score + HEADING * F.size(F.filter("_headings", lambda h, w=w: F.contains(F.lower(h), w)))
        score = score + HIT * F.least(T.count_of(F.col("_body"), w), F.lit(MOST_HITS))
    found = notes.withColumn("_headings", headings).withColumn("_body", field(F.col("body"))).withColumn("score", score).filter("score > 0")
    top = found.select("path", "title", "tags", "score", "body").orderBy(F.desc("score"), F.desc("path")).limit(top_k)
    return top.select("path", "title", "tags", "score", snippet(F.col("body"), words, snippet_chars).alias("snippet"))


def section_scores(sections: DataFrame, question: str | Column) -> DataFrame:
    """Adds score to sections (doc, pos from 0, number, title, text): 100 for
    the number asked for, else 60 for the place, 10 for each title word in the
    question, 1 for each question word in the first 500 characters."""
    q = F.lit(question) if isinstance(question, str) else question
    asked, words = T.ordinals(q), T.keywords(q)
    titled = F.regexp_extract(F.coalesce("title", F.lit("")), r"(?i)^\s*(?:第\s*)?([IVXLC]{1,6}|\d{1,3}|[一二三四五六七八九十]{1,4})\s*[.、章节\s]", 1)
    own = F.coalesce(T.ordinal(F.coalesce("number", F.lit(""))), T.ordinal(titled))
    score = F.when(F.coalesce(F.array_contains(asked, own), F.lit(False)), 100).when(F.array_contains(asked, F.col("pos") + 1), 60).otherwise(0)
    score = score + 10 * F.size(F.array_intersect(T.keywords(F.coalesce("title", F.lit(""))), words))
    body = F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(500)))
    return sections.withColumn("score", score + F.size(F.filter(words, lambda w: F.contains(body, w))))


def packed_context(scored: DataFrame, focus: int | None, budget: int, focus_limit: int, section_limit: int, least: int = 800) -> DataFrame:
    """doc, included (positions in order of choice), context: sections within a
    soft budget: the focus, then by score as far as all fit, then by position
    as far as all fit. A section that doesn't fit gets what is left if that is
    `least` or more. One document's sections meet in one row."""
    key, title = F.coalesce("section", F.lit("")), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("section") != "", F.col("section")), F.lit("?"))
    head = F.when(key != "", F.concat(F.lit("["), key, F.lit("] "), title)).otherwise(F.concat(F.lit("["), title, F.lit("]")))
    rows = scored.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "score", head.alias("head"), F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    block = lambda e, limit: F.concat(e["head"], F.lit("\n"), T.head_tail(e["text"], limit))

    def take(state: Column, e: Column, limit: Column) -> Column:
        whole = block(e, limit)
        room = budget - state["used"]
        fits = F.length(whole) <= room
        chosen = F.when(fits, whole).when(room >= least, block(e, room.cast("int")))
        skip = state["stopped"] | F.array_contains(state["included"], e["pos"])
        made = F.struct(
            (state["used"] + F.length(chosen)).alias("used"), F.lit(False).alias("stopped"),
            F.concat(state["included"], F.array(e["pos"])).alias("included"), F.concat(state["blocks"], F.array(chosen)).alias("blocks"),
        )
        over = F.struct(state["used"].alias("used"), F.lit(True).alias("stopped"), state["included"].alias("included"), state["blocks"].alias("blocks"))
        return F.when(skip, state).when(chosen.isNull(), over).otherwise(made)

    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stopped"), F.array().cast("array<int>").alias("included"), F.array().cast("array<string>").alias("blocks"))
    again = lambda s: F.struct(s["used"].alias("used"), F.lit(False).alias("stopped"), s["included"].alias("included"), s["blocks"].alias("blocks"))
    is_focus = lambda e: e["pos"] == (focus if focus is not None else -1)
    by_score = F.array_sort("s", lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["pos"] - b["pos"]).cast("int"))
    one = F.aggregate(F.filter("s", is_focus), start, lambda s, e: take(s, e, F.lit(focus_limit)), again)
    rows = rows.withColumn("st", one)
    rows = rows.withColumn("st", F.aggregate(F.filter(by_score, lambda e: e["score"] > 0), F.col("st"), lambda s, e: take(s, e, F.lit(section_limit)), again))
    rows = rows.withColumn("st", F.aggregate("s", F.col("st"), lambda s, e: take(s, e, F.lit(section_limit))))
    return rows.select("doc", F.col("st.included").alias("included"), F.array_join("st.blocks", "\n\n---\n\n").alias("context"))
