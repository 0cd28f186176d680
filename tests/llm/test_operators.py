"""The ten operators against brute force, and on rows of all awkward kinds."""

import collections
import hashlib
import pathlib
import re
import time
import types
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

import public_tokenizers as P
from quire.llm import bpe_chunks, chat, common, fingerprint, langid, neardup, packing, pii, queries, records, sharding, topk
from quire.llm.bpe import Encoder
from quire.llm.common import fresh_path

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
LONG = "Zahlen und Worte, 12 3.4 l'été naïve — " * 4000
ODD = [None, "", " \n\t ", "one two", LONG, LONG + "end", "same text here for all of us", "same text here for all of us", "😀 é <|endoftext|> \x1c  x", "a@b.org +1 (743) 555-3824 4111 1111 1111 1111 10.0.0.7", "12 34", "x" * 5000, "\\### Assistant: </turn>"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, `key` string, base string, spans string, ids string, shard int, size int, codes string, `group` string, h1 long"


def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one two"), (3, "one two"), (None, "no id one two three four five"), (None, None)]
    return spark.createDataFrame([(i, t, "en", None, None, 1, "k", "b", "s", "i", 1, 1, "c", "g", 1) for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def digest(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# 1
def test_fingerprints(spark, small):
    ids = sorted(small, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    sets = lambda t: {tuple(w[k : k + 5]) for w in [re.findall("[^ \t-\r]+", t.lower())] for k in range(max(1, len(w) - 4))}
    errors = []
    for r in queries.op1_fingerprints(spark, SMALL).collect():
        a, b = small[r["doc_id"]], small[after[r["doc_id"]]]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), digest(edited))
        for x, y, got in ((a, edited, r["near_edited"]), (a, b, r["near_next"])):
            s, t = sets(x), sets(y)
            errors.append(got - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprint.fingerprint_documents(odd(spark)).collect()
    assert len(rows) == len(ODD) + 4
    by_text = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            by_text[ODD[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""}
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0
    alone = fingerprint.fingerprint_documents(odd(spark).filter("doc_id = 6")).first()
    assert alone["near_next"] == 1.0


# 2
def brute_topk(vectors, k=5):
    whole = {i: np.floor(256 * np.asarray(v, float)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in whole if i is not None and i % 50 == 0):
        ranked = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("scale", [1.0, 0.01, 1000.0])
def test_topk(spark, scale):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.normal(size=16) * scale]) for i in range(301)]
    rows += [(400 + i, rows[7][1]) for i in range(20)] + [(450, None), (500, [1.0, None] * 8), (550, [float("nan")] * 16), (600, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("v", F.lit(1))
    got = topk.search(df, df.filter("vec_id % 50 = 0")).collect()
    assert {tuple(r) for r in got} == brute_topk(rows) and len(got) == len(brute_topk(rows))
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.search(few, few.filter("vec_id = 0")).count() == 2
    none = df.filter("vec_id < 0")
    assert topk.search(none, none).count() == 0


def test_topk_of_odd_rows(spark):
    """Null ids, repeated ids, other lengths, scores too big for 64 bits, ties over several blocks."""
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(None, [9.0, 9.0]), (None, [9.0, 9.0]), (50, [1.0]), (50, [0.5]), (60, [1.0, 0.0, 4.0]), (70, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[0][:2] == [(1, None, 256 * 256 * 27), (2, None, 256 * 256 * 27)] and [x[1] for x in got[0][2:]] == [1, 2, 3]
    assert set(got) == {0, 50} and [x[1:] for x in got[50]] == [(None, 256 * 9 * 256)] * 2 + [(i, 256 * 256) for i in range(3)]  # the bytes of 256 come before those of 128


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in random.normal(size=8) * (1 + 9 * (i % 7 == 0))]) for i in range(400)] + [(500 + i, [1.0] * 8) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect()} == brute_topk(rows)


def test_topk_broadcasts_no_vectors(spark, monkeypatch, capsys):
    """Queries times blocks of the index grow with the square of the table."""
    monkeypatch.setattr(topk, "INDEX_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    random = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in random.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id % 50 = 0"))
    assert len(got.collect()) == 40
    got.explain(mode="formatted")
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert sent and all({re.sub("#.*", "", c) for c in x.split(", ")} <= {"block", "longest", "vec_id", "least"} for x in sent), sent


@pytest.mark.parametrize("sparse", [False, True])
def test_index_block_against_all_scores(sparse):
    random = np.random.default_rng(8)
    v = (random.normal(size=(300, 24)) * 40).astype(np.int64)
    if sparse:
        v[random.random(v.shape) < 0.97] = 0
        v[5, 3] = 2**40
    block = topk.Block({"block": 0} | topk.build([*range(299), None], v))
    assert any((rows is not None) == sparse for _, rows, *_ in block.segments) and (block.values(np.arange(300)) == v).all()
    q, least = v[:20], np.full(20, -np.inf)
    least[3] = 10**6
    want = []
    for i in range(20):
        order = sorted((-int(x), j) for j, x in enumerate(v @ q[i]) if j != i)[:5]
        want += [(i, None if j == 299 else j, -s) for s, j in order if -s >= least[i]]
    assert sorted(topk.best(block, list(range(20)), q, least, 5), key=repr) == sorted(want, key=repr)


def test_searches_stop_by_proof():
    """On the given table most queries stop before the last segment, with few rows scored in full."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    v = np.floor(256 * np.array([r["embedding"] for r in rows])).astype(np.int64)
    asked = np.array([i for i, r in enumerate(rows) if r["vec_id"] % 50 == 0])
    ids, done = [r["vec_id"] for r in rows], collections.Counter()
    block = topk.Block(topk.build(ids, v))
    found = list(topk.best(block, [ids[i] for i in asked], v[asked], np.full(len(asked), -np.inf), 5, done))
    assert len(found) == 5 * len(asked) and done["stopped"] > 0.9 * len(asked)
    assert done["segments"] < (len(block.segments) - 0.5) * len(asked) and 5 * len(asked) <= done["rescored"] < 0.1 * len(asked) * len(rows)


def test_folder_without_setting():
    """A local session without spark.checkpoint.dir gets one folder; a cluster has to name its own."""
    made = lambda master, app: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master, applicationId=app))
    first = common.shared_dir(made("local[4]", "a"))
    assert first.startswith("file:///") and common.shared_dir(made("local[4]", "a")) == first != common.shared_dir(made("local[4]", "b"))
    with pytest.raises(ValueError):
        common.shared_dir(made("spark://host:7077", "c"))


# 3
def test_bpe_is_exact(spark, small):
    for path in (WORDS, BYTES):
        enc = Encoder(path)
        chunked, dec = bpe_chunks.codec(path)
        for text in [*small.values(), *[t for t in ODD if t], "I'm it's DON'T  double\n\n new", "l'eau  qu'on\tx", " a　b", "ªº½ İΣ", "a<|endoftext|> b", "word " * 3000, "x" * 3000]:
            want = enc.tokenizer.encode(text, add_special_tokens=False).ids
            ids = np.asarray(want, "<u4").tobytes()
            assert enc.encode(text) == ids and chunked.encode(text) == ids
            assert dec.decode(ids) == enc.tokenizer.decode(want, skip_special_tokens=False)


def test_chunks_are_content_defined():
    shared = "".join(chr(97 + i * i % 26) + " " * (i % 5 == 0) for i in range(3000)).encode()
    ends = [{e - n for e in bpe_chunks.chunk_ends(b"p" * n + shared) if e > n + 600} for n in (0, 13, 700)]
    assert ends[0] and ends[0] == ends[1] == ends[2]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_joins_are_repaired_until_both_sides_agree(path, small, monkeypatch):
    """Chunks of a few bytes: ends in words, in white space and in long runs."""
    monkeypatch.setattr(bpe_chunks, "LEAST", 3)
    monkeypatch.setattr(bpe_chunks, "MEAN", 8)
    inner = Encoder(path)
    made = bpe_chunks.ChunkEncoder(inner)
    texts = [t for t in small.values() if t][:60] + ["a" * 400 + "  \n " * 50 + "don't  it's " * 40 + " end  ", " x", "x ", "\n\n\n"]
    for t in texts:
        assert made.encode(t) == inner.whole(t)
    assert made.windows > 100 and made.memory


def test_codec_of_odd_rows(spark):
    rows = bpe_chunks.encode_documents(odd(spark), WORDS).collect()
    assert len(rows) == len(ODD) + 4 and all(r["ids"] == b"" and r["decoded"] == "" for r in rows if r["doc_id"] in (0, 1))
    assert bpe_chunks.encode_documents(empty(spark), WORDS).count() == 0


# 4
def turns(spark):
    rows = [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    rows += [(1, 0, "system", "Be <b>brief</b>: #1 \\l"), *[(1, i, ("assistant", "user")[i % 2], f"turn {i} " * (i % 40)) for i in range(1, 90)]]
    rows += [(2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "a: b\n", ""), (None, 1, "assistant", "nobody"), (3, 5, "assistant", "y" * 30000), (3, 6, "user", "z")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("start", F.lit("s"))


def test_chat_windows(spark):
    df = turns(spark)
    given = collections.defaultdict(list)
    for r in df.collect():
        given[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    made = chat.windows(df, budget=200, history=60)
    whole = made.collect()
    back = collections.defaultdict(list)
    for r in chat.read_back(made).collect():
        back[r["conv_id"]].append((r["window"], r["turns"], r["targets"]))
    assert set(back) == set(given)
    for conv, windows in back.items():
        windows.sort(key=lambda w: w[0])
        want = [(role, text) for _, role, text in sorted(given[conv])]
        assert [(t["role"], t["text"]) for _, ts, _ in windows for t in ts] == want
        assert [t for _, _, ts in windows for t in ts] == [text for role, text in want if role == "assistant"]
    long = [r for r in whole if r["conv_id"] == 1]
    assert len(long) > 5 and all(r["formatted"].startswith("### system: ") for r in long) and any(r["repeated"] > 1 for r in long)
    assert over_budget(whole, 200) <= 1  # a turn of 30000 letters
    assert chat.windows(df.filter("conv_id = 99")).count() == 0


def over_budget(windows, budget):
    """How many windows exceed the budget; each has a single new turn that does."""
    count = lambda text: len(regex.findall(chat.TOKEN, text))
    over = [r for r in windows if count(r["formatted"]) > budget]
    for r in over:
        turns = [t + chat.END for t in r["formatted"].split(chat.END)[:-1]]
        assert len(turns) - r["repeated"] == 1 and all(t.startswith("### system: ") for t in turns[:-1])
        assert count(turns[-1]) > budget - sum(map(count, turns[:-1]))
    return len(over)


def test_chat_windows_keep_to_the_budget(spark):
    """No window of the given conversations exceeds the budget but for a turn that does alone, and few are small."""
    made = chat.windows(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"), budget=512, history=128).collect()
    assert over_budget(made, 512) < 0.001 * len(made)
    new = [len(regex.findall(chat.TOKEN, r["formatted"])) for r in made]
    assert any(r["repeated"] > 0 for r in made) and len({r["conv_id"] for r in made}) < len(made) and np.mean(new) > 128


def test_chat_of_long_system_turns(spark):
    rows = [(c, i, "system" if i == 0 else "user", "word " * (n if i == 0 else 30)) for c, n in ((1, 600), (2, 300), (3, 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=512, history=100).collect()
    starts = {c: {r["formatted"].startswith("### system: ") for r in made if r["conv_id"] == c and r["window"] > 0} for c in (1, 2, 3)}
    assert starts == {1: {True, False}, 2: {True}, 3: {True}} and over_budget(made, 512) == 1
    assert sum(r["formatted"].startswith("### system: ") for r in made if r["conv_id"] == 1) == 1


def test_chat_with_exact_counts(spark):
    df = turns(spark).withColumn("n", F.lit(100))
    made = chat.windows(df.filter("conv_id = 1"), budget=400, history=100, tokens="n").collect()
    assert {len(r["formatted"].split(chat.END)) - 1 for r in made} == {3, 4} and {r["repeated"] for r in made} == {0, 1}


def test_chat_query(spark):
    given = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        given[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    given[-7] = [(i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    rows = queries.op4_chat_windows(spark, SMALL).collect()
    assert len(rows) == len(given)
    for r in rows:
        t = sorted(given[r["conv_id"]])
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert tuple(r)[1:5] == (len(t), digest("".join(f"{role}\n{x}\n" for _, role, x in t)), len(loss), digest(loss))


# 5
def brute_near(rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        known = [x for x in (low.get(top(i)), doc) if x is not None]
        low[top(i)] = min(known, default=None)
    return collections.Counter((doc, len(sets[i]), low[top(i)] if sets[i] else doc, (low[top(i)] if sets[i] else doc) == doc) for i, (doc, _) in enumerate(rows))


def test_near_duplicates(spark, small):
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in random.integers(0, 5000, 220)]
    rows = list(small.items()) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_003, "one two")]
    words = list(base)
    for i in range(60):  # a chain that drifts away from its start, and copies around the start
        words = list(words)
        words[int(random.integers(len(words)))] = f"new{i}"
        rows.append((20_000 + i, " ".join(words)))
        copy = list(base)
        for j in random.integers(0, len(base), 4):
            copy[j] = f"c{i}"
        rows.append((30_000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("x")).withColumn("cid", F.lit(1))
    got = collections.Counter(tuple(r) for r in neardup.near_duplicates(df).collect())
    assert got == brute_near(rows)
    assert neardup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("rows, bits", [(2048, 10**8), (7, 10**8), (2048, 1)])
def test_links_left_by_stars_are_found(spark, monkeypatch, rows, bits):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "MOST_BITS", bits)
    kept = [[10 * k + c % 3 * 1000 for k in range(95)] + [100_000 + 10 * c + k for k in range(5)] for c in range(30)]
    members = spark.createDataFrame([(1, c, c, 100, 95, bytes([c % 3] * neardup.SIZE)) for c in range(30)], "key long, cid long, component long, n long, most long, packed binary")
    sets = spark.createDataFrame([(c, s) for c, s in enumerate(kept)], "cid long, shingles array<long>")
    links = neardup.links_across(members, sets)
    assert all(r["a"] % 3 == r["b"] % 3 for r in links.collect())
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {c: c % 3 for c in range(30)}


def test_near_duplicates_without_ids(spark):
    """Rows of null ids keep their links, whatever their number."""
    base = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(8)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base] + [(7, base[0] + " other"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r["component_id"] == 7 for r in got) == 3 and sum(r["kept"] for r in got) == len(rows) - 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103), (7, 7)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}


# 6
def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(900)] + [(1000 + i, "hot") for i in range(600)] + [(2000 + i, f"pair {i // 2}") for i in range(300)] + [(None, None), (None, None), (5, "text 5"), (5, "text 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("group", F.lit("g")).repartition(5)
    got = sharding.shard_documents(df, 40).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1000]["size"] == 19 and by_id[1000]["text_crc32"] == zlib.crc32(b"hot") and by_id[None]["size"] == 16
    hot = len({r["shard"] for r in got if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1600})
    cut = sum(by_id[2000 + 2 * i]["shard"] != by_id[2001 + 2 * i]["shard"] for i in range(150))
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert hot <= 16 and cut <= 2  # 14 shards hold the text


@pytest.mark.parametrize("partitions", [1, 3, 4, 9])
def test_propagation_joins_groups(spark, partitions):
    """Rounds take links from nearly all cut to whole, shards stay even, and a text of more rows than a shard has fills whole ones."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(3000 + i, f"few {i % 150}") for i in range(600)] + [(5000 + i, "hot") for i in range(1000)]
    df, trace = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions), []
    got = sharding.shard_documents(df, 20, trace=trace).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    cut, whole = zip(*trace, strict=True)
    assert all(c + w == cut[0] + whole[0] for c, w in trace) and whole[0] < 0.1 * cut[0] and list(whole[:-1]) == sorted(set(whole[:-1]))
    text = dict(rows)
    held = collections.defaultdict(collections.Counter)
    for r in got:
        held[text[r["doc_id"]]][r["shard"]] += 1
    few = [c for t, c in held.items() if t.startswith("few")]
    assert sum(len(c) == 1 for c in few) >= 0.95 * len(few)
    assert len(held["hot"]) <= 8  # six shards would hold it


# 7
def test_language(spark):
    rows = queries.op7_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_forward_backward_is_exact():
    random = np.random.default_rng(2)
    scores, moves = random.normal(size=(2, 5, 3)), random.normal(size=(3, 3))
    p, _, _ = langid.posteriors(scores, np.array([5, 3]), moves)
    for chain, n in ((0, 5), (1, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[chain, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                total[t, y] += w
        assert np.allclose(p[chain, :n], total / total.sum(1, keepdims=True))
        assert not p[chain, n:].any()


def test_language_of_odd_rows(spark):
    model = langid.fit_texts([("the and of that with", "en"), ("der die und nicht das", "de")] * 20)
    rows = {r["doc_id"]: r for r in langid.predict(odd(spark), model, ["doc_id"]).collect()}
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (0, 1, 2, 10))
    assert rows[4]["lang_pred"] == "de"
    assert langid.predict(empty(spark), model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd(spark), langid.fit(empty(spark)), ["doc_id"]).collect()} == {"und"}
    one = langid.fit_texts([("only words here", "en")] * 3)
    assert langid.predict(odd(spark).filter("doc_id = 3"), one, ["doc_id"]).first()["lang_pred"] == "en"


def test_language_of_long_runs():
    """All letters of a run count: its language changes after 40, and its end is its own."""
    en, de = "the and of that with".split(), "der die und nicht das".split()
    labeler = langid.Labeler(langid.fit_texts([(" ".join(en), "en"), (" ".join(de), "de")] * 20))
    labels, scores = labeler.label(["theandofthat" * 4 + "dernichtunddas" * 40, "dernichtunddas" * 4 + "theandofthat" * 40, "theandofthat" * 40])
    assert labels == ["de", "en", "en"] and all(s > 0.8 for s in scores)
    run = "".join(chr(97 + i * 7 % 26) + chr(0x4E00 + i) for i in range(150))
    held = [p.strip("-") for p in langid.pieces(run)]
    assert all(len(p) <= langid.LONGEST + 2 for p in held)
    assert [p[i : i + 3] for p in held for i in range(len(p) - 2)] == [run[i : i + 3] for i in range(len(run) - 2)]
    a, b = (langid.features([w], frozenset())[0].tolist() for w in ("x" * 45 + "lich", "x" * 45 + "ance"))
    assert sorted(a) != sorted(b)


def test_evidence_of_unlearned_languages():
    """Texts in no learned language and random letters lack evidence, whatever the
    number of labels; short clean texts and those in several languages have it."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    random = np.random.default_rng(3)
    letters = [" ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)) for n in (5, 40)]
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Minden emberi lény szabadon születik és egyenlő méltósága", "Все люди рождаются свободными и равными", "人人生而自由在尊严和权利上一律平等"]
    for langs in (["en", "de", "fr", "es"], ["en", "fr"], ["es"]):
        given = [r for r in rows if r["lang"] in langs and r["text"]]
        held = [r["text"] for r in given if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
        model = langid.fit_texts(sorted((r["text"], r["lang"]) for r in given if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2))
        weigh = lambda texts: langid.Labeler(model).weigh(texts)[2]
        short = [" ".join(t.split()[:10]) for t in held if len(t.split()) >= 10]
        mixed = [" ".join(" ".join(next(r["text"] for r in given if r["lang"] == x).split()[:20]) for x in langs)]
        assert max(weigh(letters + foreign)) < model.least <= min(weigh(held + mixed))
        assert np.mean(np.array(weigh(short)) >= model.least) > 0.98


# 8
def test_records(spark):
    df = odd(spark)
    manifest = records.write_records(df, BYTES, fresh_path(spark, "t"))
    got = records.read_records(manifest).collect()
    tok = Encoder(BYTES).tokenizer
    want = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got.sort(key=lambda r: r["start"])
    at = 0
    for (doc, text), r in zip(want, got, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc, at, ids)
        at += len(ids)
    shard = max(manifest.collect(), key=lambda r: r["records"])
    picked = records.read_some(shard["path"], [shard["records"] - 1, 0])
    assert len(picked) == 2 and picked[1][1][-1] == 0
    assert records.read_records(records.write_records(empty(spark), BYTES, fresh_path(spark, "t"))).count() == 0


def test_truncated_shards_are_noticed(spark):
    """A shard that ends on the border of a record, and an index of another shard, are no complete result."""
    df = spark.createDataFrame([(i, f"some words {i} " * (i + 1)) for i in range(30)], "doc_id long, text string").coalesce(1)
    held = [r.asDict() for r in records.write_records(df, BYTES, fresh_path(spark, "t")).collect()]
    shard = max(held, key=lambda r: r["records"])
    path = shard["path"].removeprefix("file://")
    good, index = (pathlib.Path(path + x).read_bytes() for x in (".rec", ".idx"))
    read = lambda: [x for s in records.read_spans(f"file://{path}", shard["records"], shard["tokens"]) for x in s]
    assert len(read()) == shard["records"]
    last = int(np.frombuffer(index, "<u8")[-1])
    for rec, idx in ((good[:last], index), (good[:last], index[:-8]), (good, index[:-8]), (good[:-1], index), (good + good[last:], index)):
        pathlib.Path(path + ".rec").write_bytes(rec)
        pathlib.Path(path + ".idx").write_bytes(idx)
        with pytest.raises(records.Corrupt):
            read()


def test_corrupt_records_are_noticed():
    import io

    good = records.frame(b"payload")
    assert records.unframe(io.BytesIO(good)) == b"payload"
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(records.Corrupt):
            records.unframe(io.BytesIO(bytes(bad)))


# 9
def test_packing(spark):
    got = packing.pack_documents(odd(spark), WORDS, 256).collect()
    tok = Encoder(WORDS).tokenizer
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in odd(spark).collect())
    total = sum(n * (len(tok.encode(t, add_special_tokens=False).ids) + 1) for (_, t), n in texts.items())
    assert sum(r["length"] for r in got) == total
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= -(-total // 256) + 1
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_fullest_is_the_best_sum():
    random = np.random.default_rng(8)
    for _ in range(200):
        counts = {int(k): int(random.integers(1, 4)) for k in random.integers(1, 40, 6)}
        capacity = int(random.integers(1, 90))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= capacity}
        chosen = packing.fullest(counts, capacity)
        assert sum(chosen) == max(sums) and all(chosen.count(k) <= counts[k] for k in chosen)


def test_plan_uses_every_piece_once():
    histogram = {2048: 9, 1500: 40, 548: 25, 300: 200, 7: 3000, 1: 5}
    used = collections.Counter()
    for lengths, times in packing.plan(dict(histogram), 2048):
        assert sum(lengths) <= 2048
        for k in lengths:
            used[k] += times
    assert used == histogram


# 10
def brute_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k != 1 or all(int(x) <= 255 for x in m[0].split("."))) and (k != 2 or 14 <= len(d) <= 19 and luhn(d)) and (k != 3 or 10 <= len(d) <= 15):
                found.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_personal_data(spark, small):
    random = np.random.default_rng(1)
    texts = ["".join(random.choice(list("01 4..-+()a@%é😀5"), int(random.integers(0, 200)))) for _ in range(400)]
    texts += [t or "" for t in ODD] + list(small.values()) + ["a@b.c%d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "9" * 20000, "1 2 " * 5000, "a.b@c.d " * 500, "mail joe (at) foo (dot) com now", "v 4111111111111111"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, more string")
    rows = pii.redacted(pii.find_spans(df, ("doc_id", "text")), "text", "spans").select("doc_id", pii.told("base").alias("base"), pii.told("spans").alias("spans"), F.col("text").alias("clean")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["base"] == brute_spans(text)
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
        if "@" in text and "joe" not in text:
            continue
        if not r["spans"]:
            assert r["clean"] == text
    assert pii.find_spans(empty(spark)).count() == 0 and pii.find_spans(odd(spark)).count() == len(ODD) + 4


def test_reliabilities_are_recovered():
    random = np.random.default_rng(4)
    right, counts = [0.95, 0.9, 0.8, 0.7, 0.85], collections.Counter()
    for _ in range(20000):
        truth = random.random() < 0.6
        counts[0, tuple(int((1 if truth else -1) * (1 if random.random() < r else -1)) * int(random.random() < 0.8) for r in right)] += 1
    given = [(k, v, n) for (k, v), n in sorted(counts.items())]
    rates, post = pii.estimate(given)
    assert np.allclose(rates, [(r, r) for r in right], atol=0.03)
    weights = pii.train(given, post)
    n = len(pii.LABELERS)
    assert all(yes > no for yes, no in zip(weights[-2 * n : -n], weights[-n:], strict=True))


def test_labelers_disagree_on_the_given_documents(spark):
    """Estimates lie off their bounds, and the classifier takes some candidates and rejects others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = [f"word {a} word" for a in ("ann (at) site (dot) org", "mail bob [at] web.net", "call 743 555-3824 now", "tel (212) 555-0101", "ip 10[.]1[.]2[.]3", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "card 4111.1111.1111.1111")]
    false = [f"word {a} word" for a in ("1234567", "order 20240115", "aa:bb:cc:dd:ee:ff", "300.1.2.3", "0123456789012", "x9876543210z", "2024-01-15 1234")]
    added = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made + false)], "doc_id long, text string")
    found = pii.candidates(docs.unionByName(added)).persist()
    counts = pii.vote_counts(found)
    rates, post = pii.estimate(counts)
    assert len(counts) >= 20 and 0 < sum(n for (_, _, n), p in zip(counts, post, strict=True) if p < 0.5) and len(post) == len(counts)
    assert all(0.2 < x < 0.999 for r in rates for x in r) and len({round(x, 4) for r in rates for x in r}) >= 8
    rows = pii.find_spans(docs.unionByName(added)).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("n")).filter("doc_id >= 1000000").collect()
    taken = {r["doc_id"] - 10**6 for r in rows if r["n"] > r["b"]}
    assert len(taken & set(range(len(made)))) >= 5 and not taken & set(range(len(made), len(made) + len(false)))
    more = found.select(F.explode("more").alias("s")).count()
    assert more > len(made) + len(false)
    found.unpersist()


def test_personal_data_of_dense_texts(spark):
    """Two MB of matches next to each other, in time of their length."""
    texts = ["1.2.3.4 " * 250_000, "a@b.co,1.2.3.4;" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.time()
    rows = pii.redacted(pii.find_spans(df, ("doc_id", "text")), "text", "spans").select("doc_id", F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.md5(F.col("text").cast("binary")).alias("clean")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["n"] == 250_000 and tuple(got[0]["last"]) == (1_999_992, 1, 1_999_999)
    assert got[1]["n"] == 40_000 and tuple(got[1]["last"]) == (299_992 - 0, 1, 299_999)
    assert got[0]["clean"] == hashlib.md5(("[IP] " * 250_000).encode()).hexdigest()
    assert got[1]["clean"] == hashlib.md5(("[EMAIL],[IP];" * 20_000).encode()).hexdigest()
    assert time.time() - began < 150
