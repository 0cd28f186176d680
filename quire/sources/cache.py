"""A stored cache of derived data, bucketed by key: a lookup doesn't shuffle it.

    cache.create(spark, root, "content string", buckets=512)
    keyed = papers.withColumn("key", cache.key([F.col("path"), F.col("size")], "extractor-5"))
    cache.fill(keyed, root, extract)       # computes and stores what isn't there
    found = cache.lookup(keyed, root)      # key, hit and content, a row a key

Entries are appended and the newest of a key counts, so two writers that computed
the same key do no harm. A key names all that its content depends on, versions of
the code too: entries of old versions are never found again, and `prune` drops
them. A numbered file of `_versions` names the folder that stands; pruning writes
a new one. What others append to the old folder meanwhile is computed again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import vault

BUCKETS = 512
DAYS_KEPT, MOST_KEPT = 14.0, 200


def key(parts: list[Column], *versions: str) -> Column:
    """SHA-256 over the parts and versions; null isn't the empty string, and no two lists of parts read alike."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts], *map(F.lit, versions))).cast("binary"), 256)


def create(spark: SparkSession, root: str, content: str, buckets: int = BUCKETS) -> None:
    """Makes an empty cache with columns of content; an existing one is an error."""
    fs, base = vault.opened(root.rstrip("/"))
    fs.create_dir(f"{base}/{(name := uuid.uuid4().hex)}")
    vault.publish(fs, base, 1, {"folder": name, "content": content, "buckets": buckets})


def _current(root: str) -> tuple[int, dict]:
    fs, base = vault.opened(root)
    known = vault.versions(fs, base)
    if not known:
        raise FileNotFoundError(f"no cache at {root}")
    return known[-1], vault.content(fs, base, known[-1])


def _named(spark: SparkSession, root: str, of: dict) -> str:
    """The name in this session of the table in a folder of the cache."""
    path = f"{root.rstrip('/')}/{of['folder']}"
    name = "cache_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    columns = f"key STRING, at DOUBLE, {of['content']}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {of['buckets']} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)  # other sessions append too
    return name


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of each key, grouped bucket by bucket."""
    rows = spark.table(_named(spark, root, _current(root)[1]))
    rest = [c for c in rows.columns if c != "key"]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("at", F.xxhash64(*rest))).alias("_r"))
    return last.select("key", *[F.col(f"_r.{c}").alias(c) for c in rest])


def lookup(requests: DataFrame, root: str) -> DataFrame:
    """A row for each distinct key of the requests: key, hit, and the columns of the
    cache, null without a hit. Only the keys are shuffled, each once a task at most,
    so a key that is asked for very often isn't one task."""
    found = entries(requests.sparkSession, root).withColumn("hit", F.lit(True))
    asked = requests.select("key").distinct()
    return asked.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def fill(requests: DataFrame, root: str, compute: Callable[[DataFrame], DataFrame], at: float | Column) -> None:
    """Stores content for the keys that aren't in the cache. `compute` gets one of
    the rows of each such key and returns key and the columns of content; which row
    doesn't matter, as the key names all that content depends on. A row is written
    to its bucket as one file a bucket; nothing is computed for known keys."""
    spark = requests.sparkSession
    _, of = _current(root)
    one = requests.groupBy("key").agg(F.any_value(F.struct(*[c for c in requests.columns if c != "key"], F.lit(0).alias("_"))).alias("_r"))
    missing = one.join(entries(spark, root).select("key"), "key", "left_anti")
    made = compute(missing.select("key", *[F.col(f"_r.{c}").alias(c) for c in requests.columns if c != "key"]))
    name = _named(spark, root, of)
    stamp = at if isinstance(at, Column) else F.lit(float(at))
    rows = made.withColumn("at", stamp).select(*spark.table(name).columns)
    rows.repartition(of["buckets"], "key").write.insertInto(name)


def prune(spark: SparkSession, root: str, now: float, days: float = DAYS_KEPT, most: int | None = MOST_KEPT) -> bool:
    """Keeps entries of the last `days`, and of those the `most` newest keys (ties
    by key) where that is a number; the sort for it holds times and keys only, that
    many a task. False if another writer was first: nothing has changed then."""
    root = root.rstrip("/")
    version, of = _current(root)
    fs, base = vault.opened(root)
    kept = entries(spark, root).filter(F.col("at") > now - days * 86400.0)
    if most is not None:
        kept = kept.join(kept.select("key", "at").orderBy(F.desc("at"), "key").limit(most).select("key"), "key", "left_semi")
    new = of | {"folder": uuid.uuid4().hex}
    name = _named(spark, root, new)
    kept.select(*spark.table(name).columns).repartition(of["buckets"], "key").write.insertInto(name)
    try:
        vault.publish(fs, base, version + 1, new)
    except vault.VersionConflict:
        fs.delete_dir(f"{base}/{new['folder']}")
        return False
    return True
