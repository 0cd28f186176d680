"""The bucketed cache: what is computed, what is found, and which side moves."""

import re

import pytest
from pyspark.sql import functions as F

from quire.sources import cache, vault


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def root(spark, tmp_path):
    where = str(tmp_path / "cache")
    cache.create(spark, where, "content string, pages int", buckets=6)
    return where


def rows_of(spark, values):
    df = spark.createDataFrame(values, "path string, size long, key long").withColumnRenamed("key", "extra")
    return df.withColumn("key", cache.key([F.col("path"), F.col("size")], "v1"))


def counted(spark, made):
    def compute(rows):
        def run(batches):
            for b in batches:
                made.add(len(b))
                yield b.assign(content=b["path"].fillna("none") + "!", pages=1)[["key", "content", "pages"]]

        return rows.mapInPandas(run, "key string, content string, pages int")

    return compute


def test_computes_only_misses(spark, root):
    made = spark.sparkContext.accumulator(0)
    first = rows_of(spark, [("a", 1, 1), ("b", 1, 2), ("b", 1, 3), (None, None, 4), ("", None, 5)])
    assert not any(r["hit"] for r in cache.lookup(first, root).collect())
    cache.fill(first, root, counted(spark, made), 10.0)
    assert made.value == 4
    second = first.unionByName(rows_of(spark, [("c", 1, 1), ("a", 2, 1)]))  # a new size is a new key
    before = {r["key"]: r["hit"] for r in cache.lookup(second, root).collect()}
    assert sorted(before.values()) == [False] * 2 + [True] * 4
    cache.fill(second, root, counted(spark, made), 20.0)
    assert made.value == 6
    after = cache.lookup(second, root).collect()
    assert all(r["hit"] for r in after) and len(after) == 6
    assert sorted((r["at"], r["content"]) for r in after) == [(10.0, "!"), (10.0, "a!"), (10.0, "b!"), (10.0, "none!"), (20.0, "a!"), (20.0, "c!")]


def above(plan, mark):
    """The operators of a plan above the line with a mark, up to the first join."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if mark in line)
    here, found = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            found.append(line)
            if "Join" in line:
                break
    return found


def test_cache_side_is_not_shuffled(spark, root):
    rows = rows_of(spark, [("a", i, i) for i in range(50)])
    cache.fill(rows, root, counted(spark, spark.sparkContext.accumulator(0)), 1.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(cache.lookup(rows, root))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = above(plan, "Bucketed: true")
    assert "SortMergeJoin" in found[-1] and not any("Exchange" in line for line in found), plan
    # the keys of requests are made distinct, then sent to the buckets; nothing else moves
    assert re.findall(r"Exchange hashpartitioning\(key#\d+, (\d+)\)", plan) == ["6", "4"] and plan.count("Exchange ") == 2


def test_newest_entry_counts(spark, root):
    rows = rows_of(spark, [("a", 1, 1)])
    name = cache._named(spark, root, cache._current(root)[1])
    for at, content in ((5.0, "old"), (9.0, "new"), (7.0, "between")):
        rows.select("key", F.lit(at).alias("at"), F.lit(content).alias("content"), F.lit(1).alias("pages")).write.insertInto(name)
    assert [(r["at"], r["content"]) for r in cache.lookup(rows, root).collect()] == [(9.0, "new")]


def test_prune_by_age_and_number(spark, root):
    day = 86400.0
    for i in range(6):
        cache.fill(rows_of(spark, [(f"p{i}", i, 0)]), root, counted(spark, spark.sparkContext.accumulator(0)), i * day)
    assert cache.prune(spark, root, 6 * day, days=5.0, most=3)
    assert sorted(r["content"] for r in cache.entries(spark, root).collect()) == ["p3!", "p4!", "p5!"]
    assert cache.prune(spark, root, 6 * day, days=2.5, most=None)
    assert sorted(r["content"] for r in cache.entries(spark, root).collect()) == ["p4!", "p5!"]
    cache.fill(rows_of(spark, [("p9", 1, 0)]), root, counted(spark, spark.sparkContext.accumulator(0)), 6 * day)
    assert cache.entries(spark, root).count() == 3


def test_empty_and_repeated(spark, root, tmp_path):
    nothing = rows_of(spark, [])
    assert cache.lookup(nothing, root).collect() == []
    cache.fill(nothing, root, counted(spark, spark.sparkContext.accumulator(0)), 1.0)
    hot = rows_of(spark, [("h", 1, i) for i in range(500)])
    made = spark.sparkContext.accumulator(0)
    cache.fill(hot, root, counted(spark, made), 2.0)
    assert made.value == 1 and cache.lookup(hot, root).count() == 1
    with pytest.raises(vault.VersionConflict):
        cache.create(spark, root, "content string")
    with pytest.raises(FileNotFoundError):
        cache.entries(spark, str(tmp_path / "other"))
