"""The pipeline's stages, each against brute force on what the one before kept."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from quire.llm import common
from quire.llm.bpe import Encoder
from tests.llm.test_operators import brute_near, brute_spans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    twice = docs.filter("doc_id % 9 = 0")
    odd = spark.createDataFrame([(9001, None, None, "x", None), (9002, "12 34 !", "en", None, 7), (None, "the same of that and with the words in it", "en", None, 41), (None, None, None, None, None)], docs.schema)
    out = [docs.unionByName(twice).unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language(stages):
    without = lambda df: sorted((r[:2] + r[3:] for r in rows(df)), key=repr)
    given, kept = without(stages[0]), without(stages[1])
    assert set(kept) <= set(given)
    gone = [r for r in given if r not in kept]
    assert {r[1] for r in gone} <= {None, "12 34 !"} and len(gone) == 3 and len(kept) == len(given) - 3


def test_language_is_written(stages):
    """Every kept document has the language that was found, which is nearly always the given one."""
    given = {(r[0], r[1]): r[2] for r in rows(stages[0]) if r[2]}
    kept = rows(stages[1])
    assert all(r[2] in set(given.values()) for r in kept)
    known = [(r[2], given[r[0], r[1]]) for r in kept if (r[0], r[1]) in given]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_language_without_unlearned(spark):
    """Random letters and texts in unlearned languages go; short clean texts stay, whatever their ids."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    random = np.random.default_rng(3)
    gone = [" ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)) for n in (5, 40)]
    gone += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Все люди рождаются свободными и равными", "人人生而自由在尊严和权利上一律平等"]
    stay = ["the same of that and with the words in it", "der die und nicht das", "the of and in der die und nicht la les des et el los de que"]
    added = spark.createDataFrame([(20000 + i, t, None, "x", len(t)) for i, t in enumerate(gone + stay)], given.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, given.unionByName(added), SMALL).filter("source = 'x'").collect()}
    assert kept == {20000 + len(gone) + i for i in range(len(stay))}


def test_near_duplicates(stages):
    given = [(r[0], r[1]) for r in rows(stages[1])]
    want = {doc for (doc, _, _, kept), _ in brute_near(given).items() if kept}
    got = rows(stages[2])
    assert {r[0] for r in got} == want and len(got) == len({(r[0], r[1]) for r in got}) == len(want)
    assert set(got) <= set(rows(stages[1]))


def brute_kept(given):
    """Rows that stay: one of each component, by (no id, id, hash of the text); all without words, repeated ones once."""
    sets = [shingles(r[1]) for r in given]
    up = list(range(len(given)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    out = {}
    for i, r in enumerate(given):
        if not sets[i]:
            out.setdefault((r[0], r[1]), []).append(r)
    for c in {top(i) for i in range(len(given)) if sets[i]}:
        members = [r for i, r in enumerate(given) if top(i) == c]
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))
        out.setdefault((first[0], first[1]), []).extend(m for m in members if m[:2] == first[:2])
    # of rows of one id and text, the first by language, source and length, nulls first
    return sorted((min(rs, key=lambda r: [(x is not None, x) for x in r[2:5]])[:5] for rs in out.values()), key=repr)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_by_row(spark):
    """Null and repeated ids: a row stays for its own text, not for that of another row of its id."""
    random = np.random.default_rng(8)
    word = lambda n: ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(n)]
    a, b, c, d, e = (word(60) for _ in range(5))
    near = lambda w, k: " ".join([*w[:-k], *word(k)])
    text = " ".join
    given = [
        (7, text(a)), (None, near(a, 2)), (None, text(b)), (None, near(b, 1)), (None, text(b)),  # a copy of 7 without an id, and a component without ids
        (9, text(c)), (9, near(a, 1)), (9, near(c, 2)), (10, near(c, 3)),  # repeated ids with texts of two components
        (11, text(d)), (11, text(d)), (12, text(d)), (3, near(d, 1)),
        (None, None), (None, None), (None, ""), (5, None), (5, "  "), (5, None), (None, "one two"), (13, "one two"), (14, text(e)),
    ]
    rows_ = [(i, t, "en" if k % 2 else None, "xyz"[k % 3], k) for k, (i, t) in enumerate(given)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    hashed = [tuple(r) for r in docs.withColumn("h", F.xxhash64("text")).collect()]
    for parts in (1, 5):
        got = rows(corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SMALL))
        assert got == brute_kept(hashed)
    assert not any(r[0] is None and r[1] == given[1][1] for r in got) and sum(r[1] in (given[2][1], given[3][1]) for r in got) == 1
    assert all(r[1] != given[6][1] for r in got)


def test_personal_data(stages):
    before, after = {r[0]: r for r in rows(stages[2])}, {r[0]: r for r in rows(stages[3])}
    assert set(before) == set(after)
    changed = 0
    for i, r in after.items():
        assert r[2:4] == before[i][2:4] and r[4] == len(r[1])
        if brute_spans(before[i][1]):
            changed += 1
            assert not brute_spans(r[1]) and "[" in r[1]
        else:
            assert r[1] == before[i][1]
    assert changed


def test_packed(spark, stages):
    enc = Encoder(P.path("word_bpe_49k.json"))
    ids = {r[0]: enc.whole(r[1]) + b"\0\0\0\0" for r in rows(stages[3])}
    got = stages[4].collect()
    assert sum(r["length"] for r in got) * 4 == sum(map(len, ids.values()))
    places = {}
    for r in got:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(part) and r["start"] == r["piece"] * 2048
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = np.cumsum([0, *[n for _, n in sorted(p)]])
        assert [o for o, _ in sorted(p)] == at[:-1].tolist() and at[-1] <= 2048


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SMALL), "test-empty")
    assert docs.count() == 0
