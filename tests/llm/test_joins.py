"""Spelling variants, conversation repair and the n-gram join against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ngramjoin, queries, repair, variants

SMALL = "/root/testdata/sf0.001"


# 11
def brute_variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    less = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :]].add((w, i))
    near = {w: {v for i in range(len(w)) for v, j in less[w[:i] + w[i + 1 :]] if i == j and v != w} | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in n} | {v for v, _ in less.get(w, ())} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op11_spelling_variants(spark, SMALL)) == brute_variants(rows)


def test_variants_of_odd_rows(spark, monkeypatch):
    """Chains, ties, accents, long runs, nulls, repeated rows; buckets in parts give the same."""
    random.seed(3)
    words = ["abcdefgh"] * 2100 + ["abcdefgx"] * 200 + ["abcdefx"] * 19 + ["bbcdefgh"] * 2 + ["ÀÉbcdefg"] * 30 + ["Àébcdefg"] * 3 + ["àébcdefg"] * 3 + ["q" * 3_000] * 2 + ["q" * 2_999] * 25 + ["×÷aaaaaa"] * 2
    words += ["".join(random.choice("ab") for _ in range(8)) for _ in range(800)]
    random.shuffle(words)
    rows = [(i // 2, " ".join(words[i::40]), "x") for i in range(40)] + [(None, None, None), (None, "abcdefgh-Abcdefgy", "y"), (7, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    want = brute_variants([r[:2] for r in rows])
    assert told(variants.group_variants(df)) == want and any(r[1] != r[2] and r[1] for r in want)
    monkeypatch.setattr(variants, "PART", 300)  # most buckets of two-letter words are dealt
    monkeypatch.setattr(variants, "AT_ONCE", 50)
    assert told(variants.group_variants(df)) == want
    assert variants.group_variants(df.limit(0)).count() == 0


def test_one_edit():
    for a, b in itertools.product(["".join(x) for k in (2, 3, 4) for x in itertools.product("ab", repeat=k)], repeat=2):
        if len(a) - len(b) in (0, 1):
            own = {a[:i] + a[i + 1 :] for i in range(len(a))} if len(a) > len(b) else {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} - {a}
            assert variants.one_edit(a, b) == (b in own), (a, b)


# 12
def brute_repair(rows):
    """By dynamic programming over rows, with up to three insertions between two."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    nexts = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    def inserted(best):
        for _ in range(3):
            for s, (c, a, o) in list(best.items()):
                to = 3 if s == 2 else 2
                new = (c + 5, a + "I", [*o, ("assistant" if to == 3 else "user", "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, o) in best.items():
            ways = [(s, (c + 2, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for x, to in nexts[s].items():
                    ways += [(to, (c + more, a + "K", [*o, (role, text)]))] if role[:1] == x else []
                    ways += [(to, (c + more + 1, a + "R", [*o, ({"u": "user", "a": "assistant"}[x], text)]))] if x != "s" else []
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = inserted(new)
    cost, audit, out = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute_repairs(rows):
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        text = "" if kind == 1 else text
        role = "user" if kind == 4 else " " if role is None else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: brute_repair(r) for c, r in held.items()}


def test_op12(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SMALL).collect()}
    assert got == brute_repairs(rows)


@pytest.mark.parametrize("block", [512, 3])
def test_repair_of_odd_rows(spark, monkeypatch, block):
    """Nulls in all columns, other roles, equal and missing turns, long conversations; cut into blocks or not."""
    monkeypatch.setattr(repair, "BLOCK", block)
    random.seed(5)
    pick = random.choice
    rows = [(c, pick([None, i, i, i, i // 2]), pick(["user", "assistant", "assistant", "user", "system", "", "tool", None, "Ünder"]), pick(["a.", "b", "", None, "c!", " \n", f"{i}?", f"{i}."])) for c in [*range(40), None] for i in range(pick([1, 2, 5, 9]))]
    rows += [(77, i, "user" if i % 2 == 0 else "assistant", pick([f"{i} x.", "x", "again."])) for i in range(700)]
    rows += [(78, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, code string").repartition(3)
    out = repair.digested(repair.repair_conversations(repair.damaged(df)))
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == brute_repairs(rows)
    assert repair.repair_conversations(repair.damaged(df.limit(0))).count() == 0


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u."), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    got = repair.repair_conversations(df.withColumn("gone", F.lit(False))).collect()
    assert [(r["conv_id"], r["place"], r["role"], r["text"]) for r in got if r["place"] is not None] == [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "assistant", "u.")]
    assert sorted((r["conv_id"], r["cost"], r["audit"]) for r in got if r["place"] is None) == [(1, 2, "KRR"), (2, 2, "D")]


# 13
def brute_components(rows):
    def shingles(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return sorted(((doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies():
    random.seed(11)
    base = [[f"w{random.randrange(400)}" for _ in range(n)] for n in (60, 90, 33, 200)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for k in range(160):
        words = list(base[k % 4])
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = f"x{random.randrange(9)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([f"o{k}x{i}" for i in range(30)] + passage + [f"q{k}x{i}" for i in range(30)])) for k in range(40)]
    return rows + [(None, rows[3][1]), (None, None), (5000, ""), (5001, " \n "), (5002, "A b"), (5003, "a B"), (7, rows[7][1]), (6000, "long " * 100_000), (6001, "long " * 90_000 + "x")]


@pytest.mark.parametrize("block", [384, 6])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)
    rows = near_copies()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(df).collect()), key=repr)
    assert got == brute_components(rows)
    assert ngramjoin.jaccard_components(df.limit(0)).count() == 0


def test_trie_links_all_components():
    """Sets with owned parts, other sizes and sides: the same components as all pairs."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        m = int(rng.integers(2, 30))
        centres = [rng.integers(0, 1 << 40, int(rng.integers(3, 60))) for _ in range(3)]
        sets = [np.unique(np.concatenate((c[rng.random(len(c)) < 0.95], rng.integers(0, 1 << 40, int(rng.integers(0, 4)))))) for c in (centres[int(rng.integers(0, 3))] for _ in range(m))]
        sets = [s if len(s) else np.array([trial]) for s in sets]
        n, side = np.array([len(s) for s in sets]), rng.integers(0, 2, m) if trial % 2 else None
        found = ngramjoin.trie_links(sets, n, np.arange(m), side)

        def linked(a, b):
            both = len(np.intersect1d(sets[a], sets[b]))
            return 100 * both >= 80 * (n[a] + n[b] - both) and (side is None or side[a] != side[b])

        def parts(pairs):
            label = list(range(m))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(m) if label[i] == x) for x in set(label)}

        assert all(linked(a, b) for a, b in found)
        assert parts(found) == parts([p for p in itertools.combinations(range(m), 2) if linked(*p)])
