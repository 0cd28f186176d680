"""Deterministic keyed merges between two devices, and change detection.

Each side is reduced by key with aggregates that combine before the shuffle,
then the sides meet in one join; no key's rows are gathered in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.identity import djb2_base36

COLOURS = ("yellow", "green", "blue", "pink", "purple")


def last_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that comes last in a total order."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def lww_merge(existing: DataFrame, incoming: DataFrame, deleted: DataFrame, key: str = "id", stamp: str = "updated_at", pos: str = "pos", colour: str | None = "color", always: bool = False) -> DataFrame:
    """Last writer wins, tombstones last.

    Of existing rows of a key the last by pos stands, of incoming ones the
    first with the greatest stamp; an incoming row replaces an existing one if
    its stamp is strictly greater (null counts as ''), or `always`. Unknown
    colours of incoming rows become yellow. Keys in `deleted` go at the end.
    Null and empty keys take no part.
    """
    named = lambda d: d.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    stamped = lambda d: d.withColumn("_t", F.coalesce(stamp, F.lit("")))
    if colour:
        incoming = incoming.withColumn(colour, F.when(F.col(colour).isin(*COLOURS), F.col(colour)).otherwise("yellow"))
    old = last_by(stamped(named(existing)), [key], [pos])
    new = last_by(stamped(named(incoming)), [key], [pos] if always else ["_t", -F.col(pos)])
    both = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("o")).join(new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("n")), key, "full")
    newer = F.col("n").isNotNull() & (F.lit(always) | F.col("o").isNull() | (F.col("n._t") > F.col("o._t")))
    won = both.withColumn("w", F.when(newer, F.col("n")).otherwise(F.col("o"))).join(deleted.select(key), key, "left_anti")
    return won.select(key, *[F.col(f"w.{c}").alias(c) for c in existing.columns if c != key])


def inferred_tombstones(explicit: DataFrame, base: DataFrame, cloud: DataFrame, cloud_deleted: DataFrame, cloud_read: bool, key: str = "id") -> DataFrame:
    """Explicit deletes, the cloud's, and what the base had and the cloud lacks,
    the last only if the cloud was really read."""
    all_ = explicit.select(key).unionByName(cloud_deleted.select(key))
    if cloud_read:
        all_ = all_.unionByName(base.select(key).join(cloud.select(key), key, "left_anti"))
    return all_.distinct()


def three_way(pack: DataFrame, vault: DataFrame, safe: Column) -> DataFrame:
    """pack (path, body, base_hash) against vault (path, current): the outcome of
    each note: rejected, created, written, skipped or conflict."""
    joined = pack.join(vault.select(F.col("path").alias("_p"), "current"), F.col("path") == F.col("_p"), "left")
    same_base = (F.coalesce("base_hash", F.lit("")) != "") & (djb2_base36(F.col("current")) == F.col("base_hash"))
    same = F.col("current") == F.col("body")
    blank = F.col("body").isNull() | ~F.col("body").rlike(r"(?U)\S")
    outcome = F.when(blank | ~F.coalesce(safe, F.lit(False)), "rejected").when(F.col("_p").isNull(), "created").when(same, "skipped").when(same_base, "written").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_p")


def merge_pages(old: DataFrame, new: DataFrame, old_pages: DataFrame, new_pages: DataFrame, version: int) -> DataFrame:
    """Snapshot pages by paper: documents (paper_id, signature, version), pages
    (paper_id, page_num, pos, translation). Returns the pages that stand.

    Without incoming pages nothing changes (the old pages stand). With both
    signatures set and different the new pages stand; if one side has a stale
    version the other stands, if both the new one; else pages are united, new
    ones first.
    """
    count = lambda p: p.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda d, p, a: d.select("paper_id", F.struct("signature", "version").alias(a)).join(count(p).withColumnRenamed("n", f"{a}n"), "paper_id", "left")
    docs = side(old, old_pages, "o").join(side(new, new_pages, "w"), "paper_id", "full")
    sig = lambda a: F.coalesce(F.col(f"{a}.signature"), F.lit(""))
    ok = lambda a: F.coalesce(F.col(f"{a}.version") == version, F.lit(False))
    mode = (
        F.when(F.coalesce("wn", F.lit(0)) == 0, "old")
        .when((sig("o") != "") & (sig("w") != "") & (sig("o") != sig("w")), "new")
        .when(ok("o") & ok("w"), "both").when(ok("w"), "new").when(ok("o"), "old").otherwise("new")
    )
    modes = docs.select("paper_id", mode.alias("mode"))
    pages = old_pages.withColumn("side", F.lit(0)).unionByName(new_pages.withColumn("side", F.lit(1))).filter("page_num is not null")
    kept = pages.join(modes, "paper_id").filter((F.col("mode") == "both") | (F.col("mode") == F.when(F.col("side") == 0, "old").otherwise("new")))
    return last_by(kept.drop("mode"), ["paper_id", "page_num"], ["side", "pos"])


def manifest_changes(local: DataFrame, cloud: DataFrame, owner: str) -> DataFrame:
    """Push of a file manifest: local (path, size, mtime, sha256) against cloud
    (path, size, mtime, sha256, owner, deleted): the action of each path. Sizes
    and times decide first, so hashes count for changed files only."""
    theirs = cloud.select("path", F.struct("size", "mtime", "sha256", "owner", "deleted").alias("c"))
    both = local.select("path", F.struct("size", "mtime", "sha256").alias("l")).join(theirs, "path", "full")
    live = F.col("c").isNotNull() & ~F.coalesce("c.deleted", F.lit(False))
    same_stat = live & (F.col("l.size") == F.col("c.size")) & (F.abs(F.col("l.mtime") - F.col("c.mtime")) <= 1e-6)
    action = (
        F.when(F.col("l").isNull(), F.when(live & (F.col("c.owner") == owner), "tombstone").otherwise("keep"))
        .when(same_stat, "unchanged").when(live & (F.col("l.sha256") == F.col("c.sha256")), "touch").when(live, "update").otherwise("publish")
    )
    return both.select("path", action.alias("action"))


def manifest_pull(local: DataFrame, cloud: DataFrame, me: str) -> DataFrame:
    """Pull: restored, conflict, removed, retained or skipped for each cloud path."""
    mine = local.select("path", F.struct("size", "sha256").alias("l"))
    both = cloud.select("path", F.struct("size", "sha256", "owner", "deleted", "propagate").alias("c")).join(mine, "path", "left")
    gone = F.coalesce("c.deleted", F.lit(False))
    action = (
        F.when(gone & F.col("l").isNull(), "skipped").when(gone & F.coalesce("c.propagate", F.lit(False)) & (F.col("c.owner") != me), "removed").when(gone, "retained")
        .when(F.col("l").isNull(), "restored").when(F.col("l.sha256") == F.col("c.sha256"), "skipped").otherwise("conflict")
    )
    return both.select("path", action.alias("action"))


def remote_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """A remote listing (path, mtime) against local state (path, mtime, dirty):
    add, touch, update, conflict, or missing for local rows that aren't listed."""
    both = local.select("path", F.struct("mtime", "dirty").alias("l")).join(remote.select("path", F.struct("mtime").alias("r")), "path", "full")
    action = (
        F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "add").when(F.col("l.mtime") == F.col("r.mtime"), "touch")
        .when(F.coalesce("l.dirty", F.lit(False)), "conflict").otherwise("update")
    )
    return both.select("path", action.alias("action"))


def _marked(manifest: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The manifest with `_wanted`; ids that are asked for more than once count once."""
    if wanted is None:
        return manifest.withColumn("_wanted", F.lit(True))
    ids = wanted.select(F.col("id").alias("_id")).distinct().withColumn("_wanted", F.lit(True))
    return manifest.join(ids, F.col("id") == F.col("_id"), "left").drop("_id").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))


def released(manifest: DataFrame, wanted: DataFrame | None, at: Column) -> DataFrame:
    """A manifest (id, size, blob, released_at, ...) after the files of `wanted` (id;
    None: all) were taken from the shared folder to make room: their entries stay,
    without a blob. Adds freed: bytes of a blob that was there, else 0. Asking again
    only moves the stamp. An unknown size frees nothing; a null id is only in all."""
    rows = _marked(manifest, wanted)
    there = F.col("_wanted") & F.coalesce("blob", F.lit(False))
    return rows.withColumns({
        "freed": F.when(there, F.coalesce("size", F.lit(0))).otherwise(0).cast("long"),
        "blob": F.col("blob") & ~F.col("_wanted"),
        "released_at": F.when(F.col("_wanted"), at).otherwise(F.col("released_at")),
    }).drop("_wanted")


def propagated(manifest: DataFrame, wanted: DataFrame, me: str, at: Column) -> DataFrame:
    """A manifest (id, path, deleted, propagate, propagate_by, deleted_at, ...) where
    the entries of `wanted` (id) are deleted for the other devices too. Who asked is
    kept, since `manifest_pull` removes nothing of the device that did. Entries
    without a path stay as they are; `propagation` tells which."""
    rows = _marked(manifest, wanted)
    marks = F.col("_wanted") & (F.coalesce("path", F.lit("")) != "")
    then = {"deleted": F.lit(True), "propagate": F.lit(True), "propagate_by": F.lit(me), "deleted_at": at}
    return rows.withColumns({c: F.when(marks, v).otherwise(F.col(c)) for c, v in then.items()}).drop("_wanted")


def propagation(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, outcome of each distinct id that is asked for: marked, pathless or missing."""
    known = manifest.groupBy("id").agg(F.max(F.coalesce("path", F.lit("")) != "").alias("_path"))
    rows = wanted.select("id").distinct().join(known, "id", "left")
    return rows.select("id", F.when(F.col("_path").isNull(), "missing").when(F.col("_path"), "marked").otherwise("pathless").alias("outcome"))
