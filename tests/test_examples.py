"""Small worked examples of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import identity
from quire.functions import text as T
from quire.operators import chunking, curves, layout, linking, merge, rates, retrieval, sections
from quire.sources import files, json_rows, keyed_log, sinks
from quire.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


SQUARES = [(0.0, 0.0), (1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (4.0, 16.0)]


def compare(spark, paper, repro):
    of = lambda pts: spark.createDataFrame([("s", x, y, i) for i, (x, y) in enumerate(pts)], "s string, x double, y double, pos int")
    return curves.compared(curves.interpolated(of(paper), of(repro), "s", 1.5), "s").first()


@pytest.mark.parametrize("factor, verdict", [(1.0, "pass"), (1.04, "pass"), (1.10, "warn"), (1.5, "fail")])
def test_verdicts(spark, factor, verdict):
    r = compare(spark, SQUARES[::-1], [(x, y * factor) for x, y in SQUARES])
    assert r["verdict"] == verdict
    if factor == 1.0:
        assert r["rmse"] == r["mae"] == r["max_rel_err_pct"] == 0 and r["pearson_r"] == pytest.approx(1)


def test_flat_paper_is_inconclusive(spark):
    r = compare(spark, [(x, 0.0) for x, _ in SQUARES], SQUARES)
    assert r["verdict"] == "inconclusive" and r["pearson_r"] == 0.0


def test_interpolation(spark):
    paper = spark.createDataFrame([("s", x, y, i) for i, (x, y) in enumerate([*SQUARES, (0.0, 7.0), (2.0, 5.0)])], "s string, x double, y double, pos int")
    asked = spark.createDataFrame([("s", x, 0.0, 0) for x in (0.5, 1.5, 2.0, 2.5, -1.0, 0.0, 10.0)], "s string, x double, y double, pos int")
    got = {r["x"]: r["paper_y"] for r in curves.interpolated(paper, asked, "s", 1.0).collect()}
    assert got == {0.5: 4.0, 1.5: 2.5, 2.0: 5.0, 2.5: 7.0, -1.0: 0.0, 0.0: 0.0, 10.0: 16.0}


def test_point_lines(spark):
    lines = ["# c", "V_G, I_D", "0.0, 0.0", "0.1\t0.5", "0.2;1.2", "0.3 2.5", "not_a_number", "1,234.5,6.7", "nan,1", "inf,1", "", "// x", "1d,2"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r["x"], r["y"]) for r in curves.parse_points(df).collect()) == [(0.0, 0.0), (0.1, 0.5), (0.2, 1.2), (0.3, 2.5)]


def test_calibration(spark):
    at = lambda p, a, b, c, d: one(spark, curves.calibrated(*[F.lit(float(v)) for v in (p, a, b, c, d)]))
    assert [at(p, 10, 0, 190, 10) for p in (10, 100, 190)] == [0, 5, 10]
    assert [at(p, 90, 0, 10, 5) for p in (90, 50, 10)] == [0, 2.5, 5]
    assert at(5, 7, 0, 7, 1) is None


def test_ids(spark):
    path = "01_Literature/04_Survey_综述/01_论文原文_PDF/2008-JACERS-综述-Magnetoelectric laminate composites An overview.pdf"
    assert one(spark, identity.paper_id(F.lit(path))).endswith("_pgghcp")
    assert one(spark, identity.paper_id(F.lit(path.replace("/", "\\")))) == one(spark, identity.paper_id(F.lit(path)))
    assert one(spark, identity.paper_id(F.lit(""))).startswith("paper_")
    assert len(one(spark, identity.paper_id(F.lit("a/" + "x" * 99 + ".pdf"))).rsplit("_", 1)[0]) == 70
    assert one(spark, identity.file_name(F.lit(' a/b: c?.. '))) == "ab_c"
    assert one(spark, identity.file_name(F.lit("..."))) == ""
    safe = {"01_Literature/a.md": True, "../x.md": False, "logs/x.md": False, "01_Literature/x.txt": False, "/01_Literature/a.md": False, "C:/a.md": False, "01_Literature/../a.md": False, "03_Knowledge\\b.MD": True}
    assert {p: one(spark, identity.safe_target(F.lit(p))) for p in safe} == safe
    assert one(spark, identity.hamming(F.lit("f" * 64), F.lit("0" * 64))) == 256


def test_ordinals(spark):
    cases = {"请总结第 18 节的主要内容": [18], "第22节讲了什么": [22], "总结一下第四章": [4], "概括第五章的内容": [5], "Section IV 说了什么": [4], "section 7 please summarize": [7], "这一节讲了什么": [], "这篇论文有什么创新": [], "第二十三章和第十章": [10, 23], "part XLIX": [49]}
    assert {q: one(spark, T.ordinals(F.lit(q))) for q in cases} == cases


def test_text_rules(spark):
    assert one(spark, T.sentences(F.lit("A b. C d! 好。 x"))) == ["A b.", "C d!", "好。", "x"]
    assert one(spark, T.unknown_glyphs(F.lit("a(cid:3)(cid:4) b"))) == "a[?] b"
    assert one(spark, T.without_thoughts(F.lit("<think>x</think>\nyes"))) == "yes"
    assert one(spark, T.redacted_secrets(F.lit("sk-abcdefgh12 https://u:p@h/ token=abcd1234"))) == "[REDACTED] https://[REDACTED]@h/ token=[REDACTED]"
    assert one(spark, T.even_dollars(F.lit("$a$ $b\n$c$"))) == "$a$ ＄b\n$c$"
    assert one(spark, T.json_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, T.outline_title(F.lit("II. Experimental Procedure"))) == "Experimental Procedure"
    assert one(spark, T.outline_title(F.lit("3 Measurements were performed on samples"))) is None
    assert one(spark, T.clipped(T.clipped(F.lit("x" * 5000), 400), 400)) == one(spark, T.clipped(F.lit("x" * 5000), 400))
    assert one(spark, F.to_json(T.front_matter(F.lit('---\nTitle: "A: b"\nx\ntags: t\n---\nbody')))) == '{"title":"A: b","tags":"t"}'


def note(i, stamp, color="green", pos=0):
    return (i, stamp, color, pos)


NOTE = "id string, updated_at string, color string, pos int"


def test_last_writer_wins(spark):
    old = spark.createDataFrame([note("a", "2"), note("b", "2"), note("c", "2"), note("d", "9", pos=1), note("d", "1", pos=2), note("gone", "1")], NOTE)
    new = spark.createDataFrame([note("a", "3", "odd"), note("b", "1", "blue"), note("c", "2", "blue"), note("new", None), note("n2", "5", "blue", 1), note("n2", "5", "pink", 2), note("gone", "9"), note("", "1")], NOTE)
    dead = spark.createDataFrame([("gone",)], "id string")
    got = {r["id"]: (r["updated_at"], r["color"]) for r in merge.lww_merge(old, new, dead).collect()}
    assert got == {"a": ("3", "yellow"), "b": ("2", "green"), "c": ("2", "green"), "d": ("1", "green"), "new": (None, "green"), "n2": ("5", "blue")}
    again = {r["id"]: r["color"] for r in merge.lww_merge(old, new, dead, always=True).collect()}
    assert again["b"] == "blue" and again["n2"] == "pink" and "gone" not in again


def test_three_way(spark):
    base = one(spark, identity.djb2_base36(F.lit("old")))
    rows = [("01_Literature/new.md", "x", ""), ("01_Literature/a.md", "y", base), ("01_Literature/a.md", "old", base), ("01_Literature/a.md", "y", "zzz"), ("01_Literature/a.md", "old", ""), ("01_Literature/a.md", " \n", base), ("../a.md", "y", base), ("logs/x.md", "y", ""), ("01_Literature/x.txt", "y", "")]
    pack = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, body string, base_hash string")
    vault = spark.createDataFrame([("01_Literature/a.md", "old")], "path string, current string")
    got = [r["outcome"] for r in merge.three_way(pack, vault, identity.safe_target(F.col("path"))).orderBy("i").collect()]
    assert got == ["created", "written", "skipped", "conflict", "skipped", "rejected", "rejected", "rejected", "rejected"]


@pytest.mark.parametrize("old, new, want", [(("s", 5), ("s", 5), {1: "old", 2: "new", 3: "new"}), (("s", 5), ("t", 5), {2: "new", 3: "new"}), (("s", 5), ("s", 4), {1: "old", 2: "old"}), (("s", 4), ("s", 4), {2: "new", 3: "new"}), (("", 4), ("t", 5), {2: "new", 3: "new"})])
def test_page_merge(spark, old, new, want):
    doc = lambda d: spark.createDataFrame([("p", *d)], "paper_id string, signature string, version int")
    pages = lambda ns, t: spark.createDataFrame([("p", n, n, t) for n in ns], "paper_id string, page_num int, pos int, translation string")
    rows = merge.merge_pages(doc(old), doc(new), pages([1, 2], "old"), pages([2, 3], "new"), 5).collect()
    assert {r["page_num"]: r["translation"] for r in rows} == want
    kept = merge.merge_pages(doc(old), doc(new), pages([1], "old"), pages([], "new"), 5).collect()
    assert [r["page_num"] for r in kept] == [1]


def section_rows(spark, n=20):
    return spark.createDataFrame([("d", i, "", f"{i + 1}. Part {i}", f"s{i}", f"body {i} " + "x" * 3000) for i in range(n)], "doc string, pos int, number string, title string, section string, text string")


def test_context_packing(spark):
    for question, focus in (("第 18 节", None), ("what is this", 17)):
        r = retrieval.packed_context(retrieval.section_scores(section_rows(spark), question), focus, 14000, 12000, 3000).first()
        assert 17 in r["included"] and len(set(r["included"])) == len(r["included"])
        assert len(r["context"]) <= 14000 + 200
    assert retrieval.search(section_rows(spark).select(F.col("section").alias("path"), "title", F.lit("").alias("tags"), F.lit("").alias("category"), F.col("text").alias("body")), " ").count() == 0


def test_sections(spark):
    def keys(*heads):
        text = "\n".join(f"{h}\n{'word ' * 20}" for h in heads) or "plain " * 20
        return [r["section"] for r in sections.sectioned(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")).orderBy("nth").collect()]

    assert keys("1. Introduction", "2. Methods", "3. Results", "4. Conclusion") == ["introduction", "methods", "results", "conclusion"]
    assert keys("I. INTRODUCTION", "II. METHODOLOGY", "III. RESULTS") == ["introduction", "methods", "results"]
    assert keys() == ["full_text"]


def test_outline(spark):
    pages = [("d", 1, "Vol. 3\nfront\nI. Introduction\ntext ⟦FORMULA:1,2,3,4⟧ and ⟦FORMULA:1,2,3,5⟧"), ("d", 2, "12\nmore\nA. Setup\nx\nReferences\n1. Old paper title"), ("d", 3, "II. Hidden")]
    rows = sections.outline(spark.createDataFrame(pages, "doc string, page int, text string")).orderBy("nth").collect()
    assert [(r["title"], r["level"], r["formulas"]) for r in rows] == [(None, None, 0), ("Introduction", 1, 2), ("Setup", 2, 0)]
    assert rows[1]["text"] == "text 【公式1】 and 【公式2】\nmore"


def test_chunks_hold_everything():
    text = "\n\n".join(f"Paragraph {i}. " + "Some words here. " * (i % 30) for i in range(60)) + "\n\n" + "\n".join("line %d " % i + "y" * 80 for i in range(100))
    made = chunking.chunks(text, 1000, 1500, 0)
    assert "".join("".join(made).split()) == "".join(text.split())
    lapped = chunking.chunks(text, 1000, 1500, 120)
    assert len(lapped) >= len(made) and all(lapped)
    assert chunking.chunks("  ") == [] and chunking.chunks("short") == ["short"]
    assert chunking.chunks("z" * 9000) == ["z" * 9000]
    assert chunking.joined("Intro.\n\nThe same paragraph stands here.", "The same paragraph stands here!\n\nNext.") == "Intro.\n\nThe same paragraph stands here.\n\nNext."
    assert chunking.joined("abc and the seam of it all", "the seam of it all goes on") == "abc and the seam of it all goes on"


def test_layout(spark):
    lines = spark.createDataFrame([("d", 100.0, 109.0, 50.0, 90.0, "first"), ("d", 111.0, 120.0, 50.0, 95.0, "second"), ("d", 140.0, 150.0, 50.0, 95.0, "third")], "doc string, top double, bottom double, x0 double, x1 double, text string")
    rows = layout.block_texts(layout.blocks(lines, ["doc"]), ["doc"]).orderBy("block").collect()
    assert [r["text"] for r in rows] == ["first second", "third"]
    marks = spark.createDataFrame([("d", 1, 10.0, 20.0, 0.0, 100.0), ("d", 2, 11.0, 15.0, 40.0, 45.0), ("d", 3, 12.0, 16.0, 50.0, 55.0), ("d", 4, 30.0, 40.0, 0.0, 90.0)], "doc string, line long, top double, bottom double, x0 double, x1 double")
    assert {r["line"]: r["host"] for r in layout.attached(marks, ["doc"]).collect()} == {1: None, 2: 1, 3: 1, 4: None}


def test_limiter(spark):
    burst = spark.createDataFrame([("k", 0.0)] * 60, "key string, at double")
    slots = sorted(r["slot"] for r in rates.limited(burst, "key", "at", 9, 60.0, 6.0, strict=True).collect())
    assert all(b - a >= 6 - 1e-9 for a, b in zip(slots, slots[1:], strict=False))
    assert max(sum(a <= s < a + 60 for s in slots) for a in slots) <= 9
    read = sorted(r["slot"] for r in rates.limited(burst, "key", "at", 9, 60.0, 6.0).collect())
    assert max(sum(a <= s <= a + 60 for s in read) for a in read) >= 10


def test_glyphs_and_titles(spark):
    seen = spark.createDataFrame([("k", "f" * 64), ("k", "0" * 64), ("k", None), ("u", "0" * 64)], "key string, shape string")
    known = spark.createDataFrame([("k", "α", "0" * 64)], "key string, sym string, shape string")
    assert [r["sym"] for r in linking.resolved_glyphs(seen, known).orderBy("key", F.asc_nulls_first("shape")).collect()] == ["α", "α", None, None]
    titles = spark.createDataFrame([(1, "Magnetic sensor design for low noise"), (2, "Nothing alike")], "id int, title string")
    stems = spark.createDataFrame([("b.pdf", "2020_Magnetic sensor design"), ("c.pdf", "magnetic sensor")], "file string, stem string")
    assert [(r["id"], r["file"], r["score"]) for r in linking.title_matches(titles, stems, linking.STRICT).collect()] == [(1, "b.pdf", 125)]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{broken"), (3, '{"z": 1}'), (4, None)], "i int, json string")
    assert [r["state"] for r in json_rows.classified(df, "json", "k bigint").orderBy("i").collect()] == ["ok", "corrupt", "empty", "corrupt"]
    good = {"format": "notes-pack", "notes": [{"id": "a", "body": "x"}]}
    packs = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(good | {"format": "other"})), (3, json.dumps(good | {"notes": [{"id": "b"}, "text"]}))], "pack_id int, json string")
    assert [(r["pack_id"], r["id"]) for r in json_rows.accepted_packs(packs, "notes-pack").collect()] == [(1, "a")]


def test_files_and_sinks(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "01_Literature/T").mkdir(parents=True)
    (root / "logs").mkdir()
    (root / "01_Literature/T/a.md").write_text('---\ntitle: "Paper A"\n---\n# H\nbody')
    (root / "01_Literature/T/b.md").write_bytes(b"\xff\xfe bad")
    (root / "logs/c.md").write_text("# no")
    (root / "01_Literature/T/p.pdf").write_bytes(b"%PDF-1.4 x")
    (root / "01_Literature/T/q.pdf").write_bytes(b"nope")
    found = files.notes(spark, str(root)).collect()
    assert [(r["path"], r["title"]) for r in found] == [("01_Literature/T/a.md", "Paper A")]
    pdfs = files.pdf_catalogue(spark, str(root))
    assert {(r["stem"], r["topic"]) for r in pdfs.collect()} == {("p", "T"), ("q", "T")}
    assert {r["path"]: r["accepted"] for r in files.uploads(spark, str(root)).filter("path like '%pdf'").collect()} == {"01_Literature/T/p.pdf": True, "01_Literature/T/q.pdf": False}
    assert files.listing_fingerprint(pdfs).first()["files"] == 2 and [r["folder"] for r in files.folders(pdfs).collect()] == ["01_Literature/T"]
    papers = spark.createDataFrame([("On Things", "Ann Lee, Bo Wu", 2020, "Topic", "We do.", "10.1/x")], "title string, authors string, year int, category string, abstract string, doi string")
    card = sinks.literature_cards(papers).first()
    assert card["path"] == "01_Literature/Topic/2020_On_Things.md" and card["text"].startswith('---\ntitle: "On Things"\n')
    assert "author = {Ann Lee and Bo Wu}" in sinks.bibtex(papers).first()["bibtex"]
    path = sinks.write_version(papers, str(tmp_path / "t"), 1)
    sinks.write_version(papers.union(papers), str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 1


def test_streams(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    write = lambda name, rows: (inbox / name).write_text("\n".join(map(json.dumps, rows)))
    schema = "id string, updated_at string, deleted boolean, body string"
    go = lambda: flows.run_available(flows.watch(spark, str(inbox), schema), flows.lww_upserts(target, "id", "updated_at"), str(tmp_path / "ck"))
    write("1.json", [{"id": "a", "updated_at": "1", "deleted": False, "body": "x"}, {"id": "b", "updated_at": "1", "deleted": False, "body": "y"}])
    go()
    write("2.json", [{"id": "a", "updated_at": "2", "deleted": False, "body": "new"}, {"id": "b", "updated_at": "1", "deleted": True, "body": None}])
    go()
    rows = {r["id"]: (r["body"], r["deleted"]) for r in keyed_log.read(spark, target, deleted=True).collect()}
    assert rows == {"a": ("new", False), "b": (None, True)}
    stream = spark.readStream.schema("ts timestamp, k string").json(str(inbox))
    assert flows.request_counts(stream, "ts", "k").isStreaming


def test_streamed_limiter(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inbox, out = tmp_path / "in", []
    inbox.mkdir()

    def go(name, times):
        (inbox / name).write_text("\n".join(json.dumps({"key": "k", "at": t}) for t in times))
        stream = flows.limited(flows.watch(spark, str(inbox), "key string, at double"), 3, 60.0, 2.0, strict=True)
        flows.run_available(stream, lambda df, _: out.extend(r["slot"] for r in df.collect()), str(tmp_path / "ck"))

    go("1.json", [0.0, 0.0])
    go("2.json", [1.0, 1.0])
    assert out == [0.0, 2.0, 4.0, 60.0]


def test_markup():
    from quire.functions import markup

    hostile = {
        "<script>x</script>a": "a", "<xmp><img src=x onerror=alert(1)></xmp>b": "b", '<a href="javascript:alert(1)" onclick=x>c</a>': '<a href="#">c</a>',
        '<a href="//evil.com">d</a>': '<a href="#">d</a>', "AT&amp;T &#65; 1 < 2": "AT&amp;T &#65; 1 &lt; 2", '<p style="background:url(x)" class="k">e</p>': '<p class="k">e</p>',
        "<svg><svg></svg><b>no</b></svg><b>yes</b>": "<b>yes</b>", '<a href="java\nscript:x">f</a>': '<a href="#">f</a>', '<img src="a.png" alt="\'">': '<img src="a.png" alt="&#39;">', "<unknown>t</unknown>": "t",
    }
    assert {h: markup.sanitized(h) for h in hostile} == hostile


def test_fragments_are_joined(spark):
    rows = [("d", 0, "body", "L", "start", 50.0, 10.0, 90.0, 20.0, "one"), ("d", 1, "body", "L", "start", 50.0, 22.0, 95.0, 30.0, "two"), ("d", 2, "body", "L", "indent", 55.0, 31.0, 90.0, 40.0, "three"), ("d", 3, "body", "L", "gap", 80.0, 60.0, 84.0, 66.0, "3"), ("d", 4, "formula", "L", "start", 50.0, 67.0, 90.0, 70.0, "x=1")]
    boxes = spark.createDataFrame(rows, "doc string, i long, kind string, col string, split string, x0 double, top double, x1 double, bottom double, text string")
    assert [(r["text"], r["bottom"]) for r in layout.merged_fragments(boxes, ["doc"]).orderBy("i").collect()] == [("one\ntwo", 30.0), ("three\n3", 66.0), ("x=1", 70.0)]


def test_health(spark):
    rows = [("m", 0.0, "no_output"), ("m", 30.0, "check"), ("m", 60.0, "check"), ("m", 100.0, "quota"), ("m", 500.0, "check"), ("m", 1000.0, "check"), ("m", 1100.0, "check"), ("m", 1200.0, "recovered"), ("n", 5.0, "check")]
    got = rates.health(spark.createDataFrame(rows, "model string, at double, event string"), "model").orderBy("model", "at").collect()
    assert [(r["kind"], r["probe"]) for r in got] == [("no_output", False), ("no_output", False), ("", False), ("quota", False), ("quota", False), ("quota", True), ("quota", False), ("", False), ("", False)]
