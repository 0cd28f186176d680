"""A table of the newest row of each key, kept as a log of parts.

A batch writes its own rows only, as a part; parts are merged on reading, and
`fan` parts of one level at the end of the log are merged into one of the next
level, so that a row is written again about log(batches) / log(fan) times. A
numbered file of `_versions` lists the parts of each version and is made in one
step (`vault.publish`): of two writers one has to try again.

    keyed_log.upsert(batch, root, "id", "updated_at", batch_id=3)
    keyed_log.read(spark, root)            # live rows
    keyed_log.row(spark, root, "id-17")    # reads one bucket of each part

The greatest stamp of a key stands; null counts as the empty string. At equal
stamps a deletion stands, else the row of the earliest batch, and within a batch
that of the least `tie` column, then of the least row hash. Rows with `deleted`
true are tombstones: they stay in the log, so that older rows that arrive later
stay dead, until a merge that holds the oldest part finds their stamp below
`horizon`. A null key is a key like others. Batches have the columns of the
first one; others are left out, missing ones are an error.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import vault

BUCKETS = 16
FAN = 4
TRIES = 8
OWN = ("_bucket", "_part", "_seq", "_deleted")


def latest(root: str) -> tuple[int, dict]:
    """The last version and what it lists."""
    fs, base = vault.opened(root)
    known = vault.versions(fs, base)
    return (known[-1], vault.content(fs, base, known[-1])) if known else (0, {"parts": [], "batches": {}})


def _newest(rows: DataFrame, log: dict) -> DataFrame:
    """One row a key: partial maxima meet by key, no key's rows are gathered."""
    key, tie = log["key"], log["tie"]
    rest = [c for c in rows.columns if c != key]
    # the row hash makes the order total, so that merging in any order gives the same rows
    last = [-F.col(tie)] if tie else []
    rank = F.struct(F.coalesce(F.col(log["stamp"]).cast("string"), F.lit("")), "_deleted", -F.col("_seq"), *[c.alias(f"t{i}") for i, c in enumerate(last)], F.bitwise_not(F.xxhash64(*log["columns"])).alias("h"))
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return top.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, log: dict) -> str:
    """Writes a part of rows with _seq and _deleted; the name of its folder."""
    name = f"_part={uuid.uuid4().hex}"
    out = rows.withColumn("_bucket", _bucket(F.col(log["key"]), log["buckets"]))
    # a bucket is one file, or several of one hash range where it is large
    out.repartition("_bucket", F.pmod(F.xxhash64(log["key"], F.lit(1)), F.lit(4))).write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    return name


def _parts(spark: SparkSession, root: str, log: dict, names: list[str]) -> DataFrame:
    schema = f"{log['schema']}, _seq bigint, _deleted boolean, _bucket int, _part string"
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*[f"{root}/data/{n}" for n in names]).drop("_part")


def upsert(batch: DataFrame, root: str, key: str, stamp: str, batch_id: int | None = None, writer: str = "stream", tie: str | None = None, horizon: str | None = None, buckets: int = BUCKETS, fan: int = FAN) -> int:
    """Adds a batch; the version that holds it. A batch_id of `writer` that isn't
    above the last one is there already and changes nothing."""
    root, spark = root.rstrip("/"), batch.sparkSession
    fs, base = vault.opened(root)
    for _ in range(TRIES):
        version, log = latest(root)
        if batch_id is not None and batch_id <= log["batches"].get(writer, -1):
            return version
        if not version:
            columns = [c for c in batch.columns if c not in OWN]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema if f.name in columns)
            log = {"key": key, "stamp": stamp, "tie": tie, "columns": columns, "schema": schema, "buckets": buckets, "parts": [], "batches": {}}
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in log["columns"] else F.lit(False)
        rows = batch.select(*log["columns"], F.lit(version + 1).cast("long").alias("_seq"), deleted.alias("_deleted"))
        name = _write(_newest(rows, log), root, log)
        log["parts"].append({"name": name, "level": 0})
        if batch_id is not None:
            log["batches"][writer] = batch_id
        try:
            vault.publish(fs, base, version + 1, log)
        except vault.VersionConflict:
            fs.delete_dir(f"{base}/data/{name}")
            continue
        while _merge_tail(spark, root, fan, horizon):
            pass
        return version + 1
    raise vault.VersionConflict(f"{TRIES} other writers were first")


def _merge_tail(spark: SparkSession, root: str, fan: int, horizon: str | None) -> bool:
    """Merges the last `fan` parts if they are of one level."""
    _, log = latest(root)
    tail = log["parts"][-fan:]
    return len(tail) == fan and len({p["level"] for p in tail}) == 1 and compact(spark, root, len(tail), horizon)


def compact(spark: SparkSession, root: str, last: int | None = None, horizon: str | None = None) -> bool:
    """Merges the last parts (all by default) into one. False if there was
    nothing to do or another writer was first; then the next call does it."""
    root = root.rstrip("/")
    fs, base = vault.opened(root)
    version, log = latest(root)
    tail = log["parts"][-last:] if last else log["parts"]
    whole = len(tail) == len(log["parts"])
    if not tail or (len(tail) == 1 and not (whole and horizon)):
        return False
    rows = _newest(_parts(spark, root, log, [p["name"] for p in tail]).drop("_bucket"), log)
    if whole and horizon is not None:
        rows = rows.filter(~F.col("_deleted") | (F.coalesce(F.col(log["stamp"]).cast("string"), F.lit("")) >= horizon))
    name = _write(rows, root, log)
    log["parts"] = [*log["parts"][: len(log["parts"]) - len(tail)], {"name": name, "level": max(p["level"] for p in tail) + 1}]
    try:
        vault.publish(fs, base, version + 1, log)
    except vault.VersionConflict:
        fs.delete_dir(f"{base}/data/{name}")
        return False
    return True


def read(spark: SparkSession, root: str, deleted: bool = False, version: int | None = None) -> DataFrame:
    """The newest row of each key, without tombstones unless `deleted`."""
    root = root.rstrip("/")
    fs, base = vault.opened(root)
    log = latest(root)[1] if version is None else vault.content(fs, base, version)
    return _live(_parts(spark, root, log, [p["name"] for p in log["parts"]]).drop("_bucket"), log, deleted)


def row(spark: SparkSession, root: str, value: object) -> DataFrame:
    """The live row of one key; other buckets aren't read."""
    root = root.rstrip("/")
    _, log = latest(root)
    rows = _parts(spark, root, log, [p["name"] for p in log["parts"]])
    typed = F.lit(value).cast(rows.schema[log["key"]].dataType)
    return _live(rows.filter((F.col("_bucket") == _bucket(typed, log["buckets"])) & F.col(log["key"]).eqNullSafe(typed)).drop("_bucket"), log, False)


def _live(rows: DataFrame, log: dict, deleted: bool) -> DataFrame:
    found = _newest(rows, log)
    return (found if deleted else found.filter(~F.col("_deleted"))).select(log["columns"])


def vacuum(root: str, keep: int = 2) -> int:
    """Removes all but the last `keep` versions and the parts that only older
    ones name; how many parts went. A reader of an older version fails then."""
    fs, base = vault.opened(root.rstrip("/"))
    known = vault.versions(fs, base)
    named = lambda vs: {p["name"] for v in vs for p in vault.content(fs, base, v)["parts"]}
    old, kept = known[:-keep], known[-keep:]
    # parts that no version names yet may be another writer's
    gone = named(old) - named(kept)
    for v in old:
        fs.delete_file(posixpath.join(base, vault.VERSIONS, f"{v:012d}.json"))
    for name in gone:
        if fs.get_file_info(f"{base}/data/{name}").type != stores.FileType.NotFound:
            fs.delete_dir(f"{base}/data/{name}")
    return len(gone)
