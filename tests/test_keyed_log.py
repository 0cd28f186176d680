"""The keyed log against a plain dictionary, and what it writes and reads."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources import keyed_log, vault

SCHEMA = "id string, stamp string, deleted boolean, body string, pos long"


def put(spark, root, rows, n, **options):
    return keyed_log.upsert(spark.createDataFrame(rows, SCHEMA), root, "id", "stamp", batch_id=n, tie="pos", **options)


def held(spark, root, **options):
    return {r["id"]: tuple(r) for r in keyed_log.read(spark, root, **options).collect()}


def plain(batches):
    """Newest rows by (stamp, deleted, earliest batch, least pos)."""
    best = {}
    for n, rows in enumerate(batches):
        for r in rows:
            rank = (r[1] or "", bool(r[2]), -n, -r[4])
            if r[0] not in best or rank > best[r[0]][0]:
                best[r[0]] = (rank, r)
    return {k: r for k, (_, r) in best.items()}


def test_against_a_dictionary(spark, tmp_path):
    random, root, batches = np.random.default_rng(5), str(tmp_path / "t"), []
    for n in range(9):
        draw = lambda most: int(random.integers(0, most))
        rows = [(None if (k := draw(40)) == 0 else f"k{k}", None if (s := draw(6)) == 0 else str(s), [None, False, False, True][draw(4)], f"{n}-{i}", i) for i in range(60 if n != 4 else 0)]
        batches.append(rows)
        put(spark, root, rows, n)
        if n in (0, 4, 8):
            want = plain(batches)
            assert held(spark, root, deleted=True) == want
            assert held(spark, root) == {k: r for k, r in want.items() if not r[2]}
    _, log = keyed_log.latest(root)
    assert [p["level"] for p in log["parts"]] == [1, 1, 0]  # two merges of four
    assert keyed_log.compact(spark, root) and not keyed_log.compact(spark, root)
    assert held(spark, root, deleted=True) == want and len(keyed_log.latest(root)[1]["parts"]) == 1
    assert keyed_log.vacuum(root, keep=1) > 0 and held(spark, root, deleted=True) == want
    assert len(os.listdir(f"{root}/data")) == 1


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    """Of a large table nothing is written again for a small batch; the same batch again writes nothing."""
    root = str(tmp_path / "t")
    many = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("1").alias("stamp"), F.lit(False).alias("deleted"), F.sha2(F.col("id").cast("string"), 256).alias("body"), "id")
    keyed_log.upsert(many.toDF("id", "stamp", "deleted", "body", "pos"), root, "id", "stamp", batch_id=0, tie="pos")
    size = lambda name: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/data/{name}") for f in fs)
    first = keyed_log.latest(root)[1]["parts"][0]["name"]
    before = {p: size(p) for p in os.listdir(f"{root}/data")}
    assert put(spark, root, [("k7", "2", False, "new", 0), ("k8", "2", True, None, 0)], 1) == 2
    added = set(os.listdir(f"{root}/data")) - set(before)
    assert size(first) == before[first] and sum(map(size, added)) < before[first] / 50
    assert put(spark, root, [("k7", "3", False, "again", 0)], 1) == 2 and put(spark, root, [("k7", "3", False, "again", 0)], 0) == 2
    got = held(spark, root)
    assert len(got) == 19999 and got["k7"][3] == "new" and "k8" not in got
    assert put(spark, root, [("k9", "2", False, "other", 0)], 0, writer="second") == 3 and held(spark, root)["k9"][3] == "other"


def test_one_key_reads_one_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(2):
        put(spark, root, [(f"k{i}", str(n), False, f"{n}-{i}", i) for i in range(100)] + [(None, "1", False, "none", 0)], n)
    found = keyed_log.row(spark, root, "k17")
    assert [r["body"] for r in found.collect()] == ["1-17"] and keyed_log.row(spark, root, "zz").count() == 0
    assert [r["body"] for r in keyed_log.row(spark, root, None).collect()] == ["none"]
    scan = found._jdf.queryExecution().sparkPlan().toString()
    assert "_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    read = {r["f"].split("_bucket=")[1].split("/")[0] for r in spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/{p}" for p in os.listdir(f"{root}/data")]).filter("id = 'k17'").select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1


def test_tombstones_live_until_the_horizon(spark, tmp_path):
    root = str(tmp_path / "t")
    put(spark, root, [("a", "1", False, "x", 0), ("b", "1", False, "y", 0), ("c", "1", False, "z", 0)], 0)
    put(spark, root, [("a", "2", True, None, 0), ("b", "5", True, None, 0)], 1)
    put(spark, root, [("a", "1", False, "late", 0)], 2)
    assert set(held(spark, root)) == {"c"}
    assert keyed_log.compact(spark, root, last=2, horizon="9")  # the oldest part isn't in it
    assert set(held(spark, root, deleted=True)) == {"a", "b", "c"} and set(held(spark, root)) == {"c"}
    assert keyed_log.compact(spark, root, horizon="4")
    assert set(held(spark, root, deleted=True)) == {"b", "c"}
    assert keyed_log.compact(spark, root, horizon="6") and set(held(spark, root, deleted=True)) == {"c"}


def test_lost_races(spark, tmp_path, monkeypatch):
    """A writer that loses the race writes after the other; a merge that loses leaves the table as it is."""
    root = str(tmp_path / "t")
    put(spark, root, [("a", "1", False, "first", 0)], 0)
    real, lost = vault.publish, []

    def publish(fs, base, version, content):
        if not lost:
            lost.append(version)
            put(spark, root, [("a", "2", False, "theirs", 0), ("b", "2", False, "theirs", 0)], 0, writer="other")
        real(fs, base, version, content)

    monkeypatch.setattr(vault, "publish", publish)
    assert put(spark, root, [("a", "2", False, "ours", 0), ("c", "1", False, "ours", 0)], 1) == 3 and lost == [2]
    want = {"a": "theirs", "b": "theirs", "c": "ours"}
    assert {k: r[3] for k, r in held(spark, root).items()} == want
    lost.clear()
    monkeypatch.setattr(vault, "publish", lambda *_: (_ for _ in ()).throw(vault.VersionConflict("late")))
    parts = sorted(os.listdir(f"{root}/data"))
    assert not keyed_log.compact(spark, root) and sorted(os.listdir(f"{root}/data")) == parts
    with pytest.raises(vault.VersionConflict):
        put(spark, root, [("d", "1", False, "never", 0)], 2)
    assert {k: r[3] for k, r in held(spark, root).items()} == want
