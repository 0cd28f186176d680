"""The queries that SQL can't express, against brute force on the smallest tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import public_tokenizers as P
from quire.llm import queries
from quire.llm.bpe import Encoder
from tests.llm.test_operators import brute_spans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def digest(b):
    return hashlib.sha256(b).hexdigest()


def ids_of(name, docs):
    enc = Encoder(P.path(name))
    return {i: enc.whole(t) for i, t in docs.items()}, enc.tokenizer


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, SMALL).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_op3(spark, docs):
    ids, tok = ids_of("word_bpe_49k.json", docs)
    rows = queries.op3_bpe_codec(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = ids[r["doc_id"]]
        text = tok.decode(np.frombuffer(own, "<u4").tolist(), skip_special_tokens=False)
        assert tuple(r)[1:] == (len(own) // 4, digest(own), digest(text.encode()))


def test_op6(spark, docs):
    rows = queries.op6_shard_documents(spark, SMALL).collect()
    assert len(rows) == len(docs)
    held = collections.defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        held[r["shard"]].append(r["slot"])
    assert set(held) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1


def test_op8(spark, docs):
    ids, _ = ids_of("byte_bpe_50k.json", docs)
    start, want = 0, []
    for i in sorted(docs):
        own = ids[i] + b"\0\0\0\0"
        want.append((i, start, len(own) // 4, zlib.crc32(own)))
        start += len(own) // 4
    assert sorted(map(tuple, queries.op8_token_records(spark, SMALL).collect())) == want


def test_op9(spark, docs):
    ids, _ = ids_of("word_bpe_49k.json", docs)
    rows = queries.op9_pack_sequences(spark, SMALL).collect()
    places, total = collections.defaultdict(list), 0
    for r in rows:
        own = ids[r["doc_id"]] + b"\0\0\0\0"
        part = own[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(b) // 4 + 1 for b in ids.values()) and len(places) <= -(-total // 2048) + 2
    for p in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(p)]])
        assert [o for o, _ in sorted(p)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_op10(spark, docs):
    rows = queries.op10_personal_data(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute_spans(docs[r["doc_id"]])
        kinds = collections.Counter(s.split(":")[0] for s in base.split(",") if s)
        assert r["base_sha256"] == digest(base.encode()) and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
