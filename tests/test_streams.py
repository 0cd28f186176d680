"""Pages and texts as streams of sorted rows: against the rules read plainly, one page at a time."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.operators import chunking, layout


def joined_plainly(left, right, ratio=0.72, most=4, least=16, window=600):
    ends, starts = ([p for p in re.split(r"\n\s*\n", t) if p.strip()] for t in (left, right))
    ends = ends[-most:]
    alike = lambda a, b: SequenceMatcher(None, a.strip(), b.strip(), autojunk=False).ratio() >= ratio
    for n in range(min(most, len(starts)), 0, -1):
        if n <= len(ends) and all(alike(a, b) for a, b in zip(ends[-n:], starts[:n], strict=True)):
            return "\n\n".join([left, *starts[n:]])
    end, start = left[-window:], right[:window]
    m = SequenceMatcher(None, end, start, autojunk=False).find_longest_match()
    return left + right[m.size :] if m.size >= least and m.b == 0 and m.a + m.size == len(end) else f"{left}\n\n{right}"


def test_joined_as_by_all_matches():
    """Also where the end is repeated, paragraphs resemble each other or blank lines are odd."""
    pick, seams = random.Random(3), set()
    words = ["aba", "abab", "the seam", "of it all", "x", "\n\n", "\n \n\n", "abc abc abc abc abc", "zz."]
    for _ in range(1500):
        left = " ".join(pick.choices(words, k=pick.randint(1, 40)))
        right = left[-pick.randint(1, 60) :] * pick.randint(0, 2) + pick.choice(["", " ", "\n\n"]) + " ".join(pick.choices(words, k=pick.randint(1, 30)))
        got = chunking.joined(left, right)
        assert got == joined_plainly(left, right), (left, right)
        seams.add((got.startswith(f"{left}\n\n"), len(got) < len(left) + len(right)))
    assert len(seams) > 2
    left = ("a paragraph\n\n" * 2000) + "x" * 9000 + "\n\nlast one of all"
    assert chunking.joined(left, "last one of all!\n\nnext") == left + "\n\nnext" == joined_plainly(left, "last one of all!\n\nnext")


def test_unlike_paragraphs_are_settled_by_bounds(monkeypatch):
    pick = random.Random(4)
    a, b = (" ".join(pick.choices("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split(), k=300))[:1500] for _ in range(2))
    assert chunking.common("abcbdab", "bdcaba") == 4
    b = "".join(pick.sample(b, len(b)))  # the same letters in another order
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", None)
    assert not chunking.alike(a, b, 0.72) and chunking.alike(a, f" {a}\n", 0.72)


def test_rejoined_without_groups(spark):
    texts = {k: [f"Part {i} of {k} is here.\n\nIt ends so {i}." for i in range(k % 5 + 1)] for k in range(40)}
    rows = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "k long, n int, chunk string")
    found = chunking.reassembled(rows.orderBy(F.rand(1)), "k")
    wanted = {}
    for k, t in texts.items():
        for c in t:
            wanted[k] = joined_plainly(wanted[k], c) if k in wanted else c
    assert {r["k"]: r["text"] for r in found.collect()} == wanted
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_attached_and_merged_without_groups(spark):
    """Pages of one task don't touch each other; null measures attach and join nothing."""
    pick = random.Random(6)
    lines = [(p, i, float(i * 4), i * 4.0 + pick.choice([5.0, 12.0, 30.0]), float(pick.randint(0, 9)), pick.choice([None, 20.0, 40.0])) for p in (*range(30), None) for i in range(12)]
    rows = spark.createDataFrame(lines, "p int, line long, top double, bottom double, x0 double, x1 double")
    found = layout.attached(rows.orderBy(F.rand(1)), ["p"])
    wanted = {}
    for p in (*range(30), None):
        last = None
        for r in sorted((r for r in lines if r[0] == p), key=lambda r: (r[2], r[4])):
            inside = last and None not in (r[5], last[5]) and r[4] >= last[4] and r[5] <= last[5]
            held = inside and (min(r[3], last[3]) - max(r[2], last[2])) / (r[3] - r[2]) >= 0.6
            wanted[p, r[1]] = last[1] if held else None
            last = last if held else r
    assert {(r["p"], r["line"]): r["host"] for r in found.collect()} == wanted and any(wanted.values())
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()

    boxes = rows.select("p", F.col("line").alias("i"), F.lit("body").alias("kind"), F.lit(0).alias("col"), F.when(F.col("line") % 3 == 0, "start").otherwise("indent").alias("split"), "x0", "top", "x1", "bottom", F.concat(F.lit("text "), "line").alias("text"))
    found = layout.merged_fragments(boxes, ["p"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["i"]):
        got.setdefault(r["p"], []).append((r["i"], r["text"]))
    assert {k: [t for _, t in v] for k, v in got.items()} == {p: ["text 0", "text 1", "text 2\ntext 3", "text 4", "text 5\ntext 6", "text 7", "text 8\ntext 9", "text 10", "text 11"] for p in (*range(30), None)}
    assert all([i for i, _ in v] == list(range(9)) for v in got.values())
