"""Queries that take whole tables, against brute force."""

import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quire.functions.text import untranslated_runs
from quire.plans import registry

SF = "/root/testdata/sf0.001"


def given(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def result(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def test_rejoined(spark):
    """Every document that has text comes back, whatever its language."""
    words = lambda t: (t or "").split()
    want = {r["doc_id"]: words(r["text"]) for r in given("documents") if words(r["text"])}
    got = {r["doc_id"]: words(r["text"]) for r in result(spark, "rejoined")}
    bad = [(k, len(want[k]), len(got.get(k, []))) for k in want if got.get(k) != want[k]]
    assert set(got) == set(want) and not bad, bad


def test_untranslated(spark):
    """Runs in documents of all languages."""
    want = {}
    for r in given("documents"):
        runs = [m.group() for m in re.finditer(r"[A-Za-z][A-Za-z'-]*(?:[ \t]+[A-Za-z][A-Za-z'-]*){7,}", r["text"] or "")]
        runs = [x for x in runs if not re.search(r"(?i)https?|www|\bdoi\b|\bfig\b|\beq\b", x) and not all(w[0].isupper() or len(w) <= 2 for w in x.split())]
        if runs:
            want[r["doc_id"]] = (len(runs), sum(map(len, runs)))
    langs = {r["lang"] for r in given("documents") if r["doc_id"] in want}
    assert len(langs) > 2
    assert {r["doc_id"]: (r["runs"], r["chars"]) for r in result(spark, "untranslated")} == want


def test_untranslated_of_long_runs(spark):
    text = "word " * 20000
    got = spark.createDataFrame([(text,)], "t string").select(untranslated_runs(F.col("t")).alias("r")).first()["r"]
    assert got == [text.strip()]


def test_token_budgets(spark):
    """A budget of each document, also where the number of characters isn't a multiple of five."""
    caps = {"en": 2000, "de": 8000}
    want = {r["doc_id"]: (min(max(int(r["n_chars"] * 1.6), 4000), 16000), min(max(min(r["n_chars"], 80000), 300), caps.get(r["lang"], 50000))) for r in given("documents")}
    assert {r["doc_id"]: (r["low"], r["n"]) for r in result(spark, "token_budgets")} == want


def test_navigation(spark):
    want = {r["doc_id"] for r in given("documents") if r["doc_id"] % 7 and "ering" in (r["text"] or "").lower()}
    assert any(r["n_chars"] % 7 == 0 for r in given("documents") if r["doc_id"] in want)
    got = result(spark, "navigation")
    assert {r["doc_id"] for r in got} == want and [(r["rank"], r["source"], r["doc_id"]) for r in got] == sorted((r["rank"], r["source"], r["doc_id"]) for r in got)


def placed(r):
    """(n, x0, x1) of the lines of a document in two columns."""
    for n, line in enumerate(r["text"].split("\n")):
        x = 50 + len(line) % 4 * 6 + n % 2 * 330
        yield n, x, x + min(len(line), 500)


def covers():
    out = {}
    for r in given("documents"):
        ink = out.setdefault(r["doc_id"], {})
        for _, x0, x1 in placed(r):
            for b in range(min(int(x0 / 700 * 120), 119), min(int(x1 / 700 * 120), 119) + 1):
                ink[b] = ink.get(b, 0) + x1 - x0
    return out


def test_ink_coverage(spark):
    want = {(d, b): w for d, ink in covers().items() for b, w in ink.items()}
    assert {(r["doc_id"], r["bin"]): r["ink"] for r in result(spark, "ink_coverage")} == want


def test_gutters(spark):
    want = {}
    for d, ink in covers().items():
        bins = sorted(b for b, w in ink.items() if w > 0)
        gaps = [(b - a - 1, -a) for a, b in zip(bins, bins[1:], strict=False) if b - a > 1]
        if gaps:
            want[d] = (1 - max(gaps)[1], max(gaps)[0])
    assert want and {r["doc_id"]: (r["start"], r["length"]) for r in result(spark, "gutters")} == want


def test_clamped_boxes(spark):
    """A box of each line, on its page of seven lines."""
    want = {}
    for r in given("documents"):
        for n, line in enumerate(r["text"].split("\n")):
            k = len(line)
            x, top = 50 + k % 4 * 6, 12 * (n % 7) + k % 3
            want[r["doc_id"], n] = (x - 2, max(top - 2, 0), min(x + min(k, 500) + 2, 300), min(top + 9 + r["doc_id"] % 5 + 2, 90))
    assert max(n for _, n in want) > 7
    assert {(r["doc_id"], r["n"]): tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in result(spark, "clamped_boxes")} == want


def norm(t):
    return re.sub(r"[^a-zA-Z0-9一-龥]", "", t or "").lower()


def best(titles, files, two, three, one, least):
    """The best file of each title, of all pairs."""
    out = {}
    for i, title in titles:
        t, words = norm(title), [w for w in map(norm, re.split(r"\W+", title, flags=re.A)) if len(w) >= 3][:8]
        scores = []
        for file, stem in files:
            s = norm(stem)
            if not t or not s:
                continue
            hits = sum(w in s for w in words)
            score = 70 if t[:18] in s or s in t else 45 if t[:10] in s else 0
            score += three + hits * 10 if hits >= 3 else two if hits == 2 else one if hits == 1 and len(words) <= 2 else 0
            scores += [(-score, file)] if score >= least else []
        if scores:
            out[i] = (min(scores)[1], -min(scores)[0])
    return out


def test_titles_of_all_pages(spark):
    rows = [(r["page_id"], r["url"]) for r in given("pages")]
    part = lambda p, u: m.group(1) if (m := re.search(p, u)) else ""
    sides = [(i, part(r"https?://[^.]*(.*)", u)) for i, u in rows], [(i, part(r"https?://([^?]*)", u)) for i, u in rows]
    for name, weights in (("title_links", (20, 25, 0, 70)), ("title_search", (45, 25, 35, 45))):
        want = best(*sides, *weights)
        assert {i % 2 for i in want} == {0, 1} and {f % 2 for f, _ in want.values()} == {0, 1}
        assert {r["id"]: (r["file"], r["score"]) for r in result(spark, name)} == want


def test_long_stems_and_words(spark):
    """Stems of over 300 characters inside titles, and words of over 80 inside stems."""
    from quire.operators import linking

    stem, word = "".join(chr(97 + i * i % 23) for i in range(320)), "".join(chr(97 + i * 5 % 19) for i in range(95))
    titles = [(1, "qq" * 9 + stem + "zz"), (2, "ab " + word), (3, "nothing of this kind")]
    files = [("long", stem), ("word", "k" * 12 + word + "k"), ("near", stem[:12] + "0" * 310), ("other", "plain stem")]
    got = linking.title_matches(spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(files, "file string, stem string"), linking.LENIENT)
    want = best(titles, files, 45, 25, 35, 45)
    assert want[1] == ("long", 70) and {r["id"]: (r["file"], r["score"]) for r in got.collect()} == want
    one = linking.title_matches(spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(files, "file string, stem string"), linking.Weights(35, 45, 25, 35))
    assert {r["id"]: (r["file"], r["score"]) for r in one.collect()} == best(titles, files, 45, 25, 35, 35) and 2 in best(titles, files, 45, 25, 35, 35)
