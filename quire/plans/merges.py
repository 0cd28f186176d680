"""Merge queries on events: even event_id is device A (existing), odd is device B
(incoming), user_id the key, ts the stamp, event_type the colour."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import identity
from quire.operators import merge
from quire.plans.registry import ORACLES, query
from quire.session import table
from quire.sources import cache, keyed_log
from quire.sources.tables import shared_dir, written

#: Batches of device B, and a stamp after all others.
BATCHES, LAST = 5, "9999"

STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
NOTES = f"""e AS (SELECT user_id AS id, event_id AS pos, {STAMP} AS updated_at,
 CASE event_type WHEN 'click' THEN 'green' WHEN 'view' THEN 'blue' ELSE event_type END AS color, event_id % 2 AS dev, value FROM events),
o AS (SELECT id, pos, updated_at, color FROM e WHERE dev = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1),
w AS (SELECT id, pos, updated_at, CASE WHEN color IN ('yellow','green','blue','pink','purple') THEN color ELSE 'yellow' END AS color FROM e WHERE dev = 1
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, pos) = 1),
d AS (SELECT DISTINCT id FROM e WHERE id % 7 = 0 AND value > 50)"""


def notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    colour = F.when(F.col("event_type") == "click", "green").when(F.col("event_type") == "view", "blue").otherwise(F.col("event_type"))
    rows = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), colour.alias("color"), (F.col("event_id") % 2).alias("dev"), "value")
    side = lambda n: rows.filter(F.col("dev") == n).select("id", "pos", "updated_at", "color")
    return side(0), side(1), rows.filter("id % 7 = 0 and value > 50").select("id").distinct()


@query("annotations_lww", f"""WITH {NOTES} SELECT id, CASE WHEN n THEN w_pos ELSE o_pos END AS pos, CASE WHEN n THEN wt ELSE ot END AS updated_at, CASE WHEN n THEN wc ELSE oc END AS color FROM (
 SELECT coalesce(o.id, w.id) AS id, o.pos AS o_pos, w.pos AS w_pos, o.updated_at AS ot, w.updated_at AS wt, o.color AS oc, w.color AS wc,
 w.id IS NOT NULL AND (o.id IS NULL OR w.updated_at > o.updated_at) AS n FROM o FULL JOIN w ON o.id = w.id) WHERE id NOT IN (SELECT id FROM d)""")
def annotations_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.lww_merge(*notes(spark, sf_dir))


@query("annotations_log", ORACLES["annotations_lww"])
def annotations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of annotations_lww as a log: what stands on A, what B sends in
    batches by place, then the deletions."""
    old, new, dead = notes(spark, sf_dir)
    root = f"{shared_dir(spark)}/annotations-{uuid.uuid4().hex}"
    ends = new.agg(F.min("pos").alias("a"), F.max("pos").alias("b")).first()
    named = F.when(F.col("color").isin(*merge.COLOURS), F.col("color")).otherwise("yellow")
    live = lambda d: d.withColumn("deleted", F.lit(False))
    put = lambda d, n: keyed_log.upsert(d, root, "id", "updated_at", batch_id=n, tie="pos")
    put(live(merge.last_by(old, ["id"], ["pos"])), 0)
    part = F.floor((F.col("pos") - F.lit(ends["a"])) * BATCHES / F.lit((ends["b"] or 0) - (ends["a"] or 0) + 1))
    for n in range(BATCHES):
        put(live(new.filter(part == n).withColumn("color", named)), n + 1)
    put(dead.select("id", F.lit(None).cast("long").alias("pos"), F.lit(LAST).alias("updated_at"), F.lit(None).cast("string").alias("color"), F.lit(True).alias("deleted")), BATCHES + 1)
    return keyed_log.read(spark, root).drop("deleted")


@query("annotations_override", f"""WITH {NOTES}, v AS (SELECT id, pos, updated_at, CASE WHEN color IN ('yellow','green','blue','pink','purple') THEN color ELSE 'yellow' END AS color FROM e WHERE dev = 1
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)
SELECT id, pos, updated_at, color FROM v WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM v) AND id NOT IN (SELECT id FROM d)""")
def annotations_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.lww_merge(*notes(spark, sf_dir), always=True)


@query("tombstones", """WITH b AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 2 = 0), c AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 3 = 0),
x AS (SELECT DISTINCT user_id AS id FROM events WHERE value > 99), y AS (SELECT DISTINCT user_id AS id FROM events WHERE value < 0.5)
SELECT id FROM x UNION SELECT id FROM y UNION (SELECT id FROM b EXCEPT SELECT id FROM c)""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    ids = lambda cond: e.filter(cond).select("id").distinct()
    return merge.inferred_tombstones(ids("value > 99"), ids("event_id % 2 = 0"), ids("event_id % 3 = 0"), ids("value < 0.5"), True)


@query("annotations_deleted", "SELECT user_id AS id, count(*) AS removed FROM events WHERE user_id % 10 = 3 GROUP BY 1")
def annotations_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes by id and counts what was really removed."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return e.join(e.filter("id % 10 = 3").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("removed"))


DJB2 = "lower(b36) AS h"
PACK = """p AS (SELECT event_id, ['01_Literature/n', '../x', '03_Knowledge/n', 'logs/n'][1 + event_id % 4] || user_id || CASE WHEN event_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path,
 CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS body, user_id, event_type FROM events WHERE event_id % 2 = 1),
v AS (SELECT path, max(event_type) AS current FROM (SELECT '01_Literature/n' || user_id || '.md' AS path, event_type FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT '03_Knowledge/n' || user_id || '.md', event_type FROM events WHERE event_id % 6 = 0) GROUP BY path),
h AS (SELECT t, list_reduce([5381::BIGINT] || list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (a * 33 + c) % 4294967296) AS n FROM (SELECT DISTINCT event_type AS t FROM events)),
k AS (SELECT t, ltrim(array_to_string(list_transform([6,5,4,3,2,1,0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + ((n // (36 ** i)::BIGINT) % 36)::INT, 1)), ''), '0') AS code FROM h)"""


def pack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    root = F.get(F.array(*map(F.lit, ("01_Literature/n", "../x", "03_Knowledge/n", "logs/n"))), (F.col("event_id") % 4).cast("int"))
    path = F.concat(root, F.col("user_id").cast("string"), F.when(F.col("event_id") % 9 == 0, ".txt").otherwise(".md"))
    body = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type"))
    base = F.when(F.col("event_id") % 5 < 3, identity.djb2_base36(F.lit("view"))).otherwise(identity.djb2_base36(F.lit("click")))
    notes_ = e.filter("event_id % 2 = 1").select("event_id", path.alias("path"), body.alias("body"), base.alias("base_hash"))
    held = lambda cond, root: e.filter(cond).select(F.concat(F.lit(root), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "event_type")
    vault = held("event_id % 2 = 0", "01_Literature/n").unionByName(held("event_id % 6 = 0", "03_Knowledge/n")).groupBy("path").agg(F.max("event_type").alias("current"))
    return notes_, vault


@query("three_way_notes", f"""WITH {PACK} SELECT p.event_id, CASE WHEN trim(p.body) = '' OR p.path LIKE '../%' OR p.path LIKE 'logs/%' OR p.path NOT LIKE '%.md' THEN 'rejected'
 WHEN v.path IS NULL THEN 'created' WHEN v.current = p.body THEN 'skipped'
 WHEN k.code = CASE WHEN p.event_id % 5 < 3 THEN (SELECT code FROM k WHERE t = 'view') ELSE (SELECT code FROM k WHERE t = 'click') END THEN 'written' ELSE 'conflict' END AS outcome
FROM p LEFT JOIN v ON p.path = v.path LEFT JOIN k ON k.t = v.current""")
def three_way_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes_, vault = pack(spark, sf_dir)
    return merge.three_way(notes_, vault, identity.safe_target(F.col("path"))).select("event_id", "outcome")


SNAP = """e AS (SELECT *, CASE WHEN user_id % 11 = 0 THEN 0 ELSE event_id % 2 END AS dev FROM events),
s AS (SELECT user_id AS paper_id, dev, CASE WHEN max(event_id) % 5 = 0 THEN 4 ELSE 5 END AS version FROM e GROUP BY 1, 2),
d AS (SELECT paper_id, dev, CASE WHEN paper_id % 4 = 0 THEN 's' || dev ELSE 'same' END AS signature, version FROM s),
pg AS (SELECT user_id AS paper_id, dev, event_id % 12 AS page_num, event_id AS pos, event_type AS translation FROM e),
c AS (SELECT paper_id, count(*) FILTER (dev = 0) AS no, count(*) FILTER (dev = 1) AS nw FROM pg GROUP BY 1),
m AS (SELECT coalesce(o.paper_id, w.paper_id) AS paper_id, CASE WHEN coalesce(nw, 0) = 0 OR w.paper_id IS NULL THEN 'old' WHEN o.signature <> w.signature THEN 'new'
 WHEN o.version = 5 AND w.version = 5 THEN 'both' WHEN w.version = 5 THEN 'new' WHEN o.version = 5 THEN 'old' ELSE 'new' END AS mode
 FROM (SELECT * FROM d WHERE dev = 0) o FULL JOIN (SELECT * FROM d WHERE dev = 1) w ON o.paper_id = w.paper_id LEFT JOIN c ON c.paper_id = coalesce(o.paper_id, w.paper_id))"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "paper_id").withColumn("dev", F.when(F.col("paper_id") % 11 == 0, F.lit(0)).otherwise(F.col("event_id") % 2))
    docs = e.groupBy("paper_id", "dev").agg(F.max("event_id").alias("m"))
    docs = docs.select("paper_id", "dev", F.when(F.col("paper_id") % 4 == 0, F.concat(F.lit("s"), F.col("dev").cast("string"))).otherwise("same").alias("signature"), F.when(F.col("m") % 5 == 0, 4).otherwise(5).alias("version"))
    pages = e.select("paper_id", "dev", (F.col("event_id") % 12).alias("page_num"), F.col("event_id").alias("pos"), F.col("event_type").alias("translation"))
    of = lambda d, n: d.filter(F.col("dev") == n).drop("dev")
    return of(docs, 0), of(docs, 1), of(pages, 0), of(pages, 1)


@query("snapshot_pages", f"""WITH {SNAP} SELECT pg.paper_id, page_num, translation, pos FROM pg JOIN m USING (paper_id) WHERE mode = 'both' OR mode = CASE WHEN dev = 0 THEN 'old' ELSE 'new' END
QUALIFY row_number() OVER (PARTITION BY pg.paper_id, page_num ORDER BY dev DESC, pos DESC) = 1""")
def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_pages(*snapshots(spark, sf_dir), version=5).select("paper_id", "page_num", "translation", "pos")


@query("snapshot_list", """SELECT user_id AS paper_id, count(*) AS pages, count(*) FILTER (value > 50) AS translated, max(ts)::TIMESTAMP AS saved_at FROM events GROUP BY 1""")
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and translated pages of each paper, newest first."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("paper_id"))
    return e.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("value") > 50).alias("translated"), F.max("ts").alias("saved_at")).orderBy(F.desc("saved_at"), "paper_id")


@query("output_stats", """WITH a AS (SELECT user_id AS paper_id, event_id % 2 AS prio, ts, event_id, value > 50 AS done FROM events),
n AS (SELECT paper_id, prio, max(ts) AS saved_at, count(*) FILTER (done) AS pages FROM a GROUP BY 1, 2),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY saved_at DESC, prio) = 1) SELECT count(*) AS papers, sum(pages)::BIGINT AS pages FROM t""")
def output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated pages over two snapshot folders, the latest of each paper."""
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("paper_id"), (F.col("event_id") % 2).alias("prio"))
    n = a.agg(F.max("ts").alias("saved_at"), F.count_if(F.col("value") > 50).alias("n"))
    best = n.groupBy("paper_id").agg(F.max_by("n", F.struct("saved_at", -F.col("prio"))).alias("n"))
    return best.agg(F.count(F.lit(1)).alias("papers"), F.sum("n").alias("pages"))


MAN = """l AS (SELECT o_orderkey AS path, (o_totalprice * 100)::BIGINT AS size, o_orderkey % 1000 + 0.5 AS mtime, md5(o_orderpriority) AS sha FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey AS path, (o_totalprice * 100)::BIGINT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size, o_orderkey % 1000 + 0.5 AS mtime,
 CASE WHEN o_orderkey % 14 = 0 THEN 'x' ELSE md5(o_orderpriority) END AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS owner, o_orderkey % 11 = 0 AS deleted, o_orderkey % 22 = 0 AS propagate FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 5 = 0)"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    size, mtime, sha = F.round(F.col("o_totalprice") * 100).cast("long"), (k % 1000 + 0.5).cast("double"), F.md5(F.col("o_orderpriority").cast("binary"))
    local = o.filter(k % 5 != 0).select(k.alias("path"), size.alias("size"), mtime.alias("mtime"), sha.alias("sha256"))
    cloud = o.filter((k % 4 != 0) | (k % 5 == 0)).select(
        k.alias("path"), (size + F.when(k % 7 == 0, 1).otherwise(0)).alias("size"), mtime.alias("mtime"), F.when(k % 14 == 0, "x").otherwise(sha).alias("sha256"),
        F.when(k % 2 == 0, "a").otherwise("b").alias("owner"), (k % 11 == 0).alias("deleted"), (k % 22 == 0).alias("propagate"),
    )
    return local, cloud


@query("manifest_push", f"""WITH {MAN} SELECT coalesce(l.path, c.path) AS path, CASE WHEN l.path IS NULL THEN CASE WHEN NOT c.deleted AND owner = 'a' THEN 'tombstone' ELSE 'keep' END
 WHEN c.path IS NULL OR c.deleted THEN 'publish' WHEN l.size = c.size AND l.mtime = c.mtime THEN 'unchanged' WHEN l.sha = c.sha THEN 'touch' ELSE 'update' END AS action FROM l FULL JOIN c ON l.path = c.path""")
def manifest_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.manifest_changes(*manifests(spark, sf_dir), owner="a")


@query("manifest_pull", f"""WITH {MAN} SELECT c.path, CASE WHEN deleted AND l.path IS NULL THEN 'skipped' WHEN deleted AND propagate AND owner <> 'a' THEN 'removed' WHEN deleted THEN 'retained'
 WHEN l.path IS NULL THEN 'restored' WHEN l.sha = c.sha THEN 'skipped' ELSE 'conflict' END AS action FROM c LEFT JOIN l ON l.path = c.path""")
def manifest_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.manifest_pull(*manifests(spark, sf_dir), me="a")


@query("manifest_status", f"WITH {MAN} SELECT owner, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (deleted) AS deleted FROM c GROUP BY owner")
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cloud = manifests(spark, sf_dir)
    return cloud.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("deleted").alias("deleted"))


@query("remote_scan", f"""WITH {MAN} SELECT coalesce(l.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'add' WHEN l.size = c.size THEN 'touch' WHEN l.path % 3 = 0 THEN 'conflict' ELSE 'update' END AS action
FROM l FULL JOIN c ON l.path = c.path""")
def remote_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, cloud = manifests(spark, sf_dir)
    return merge.remote_changes(local.select("path", F.col("size").alias("mtime"), (F.col("path") % 3 == 0).alias("dirty")), cloud.select("path", F.col("size").alias("mtime")))


@query("progress_latest", "SELECT user_id, arg_max(event_type, event_id) AS mode, max(event_id) AS event_id FROM events GROUP BY user_id")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer reading progress of each key."""
    return merge.last_by(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode"), "event_id", F.col("event_id").alias("k")), ["user_id"], ["k"]).drop("k")


@query("layered_annotations", """WITH c AS (SELECT user_id, 0 AS rank, count(*) AS n, max(event_id) AS top FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, 1, count(*), max(event_id) FROM events WHERE event_type = 'click' GROUP BY 1
 UNION ALL SELECT DISTINCT user_id, 2, 0, NULL FROM events) SELECT user_id, rank, n, top FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) = 1""")
def layered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of each key that has rows: current, legacy, else nothing."""
    e = table(spark, sf_dir, "events")
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    counts = e.groupBy("user_id", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"))
    best = counts.groupBy("user_id").agg(F.min(F.struct("rank", "n", "top")).alias("b"))
    held = F.col("b.rank") < 2
    return best.select("user_id", "b.rank", F.when(held, F.col("b.n")).otherwise(0).alias("n"), F.when(held, F.col("b.top")).alias("top"))


@query("stale_snapshots", "SELECT user_id, event_id, coalesce(event_id % 5 <> 0, false) AS fresh, CASE WHEN event_id % 5 <> 0 THEN event_type END AS translation FROM events")
def stale_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of snapshots of another extractor version, or of none, are emptied."""
    e = table(spark, sf_dir, "events").withColumn("version", F.when(F.col("event_id") % 5 != 0, 5))
    fresh = F.col("version").eqNullSafe(F.lit(5))
    return e.select("user_id", "event_id", fresh.alias("fresh"), F.when(fresh, F.col("event_type")).alias("translation"))


@query("repeated_pages", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that one save holds more than once."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("change_pack", "SELECT user_id, count(*) AS notes, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events WHERE value > 90 AND event_type <> 'view' GROUP BY user_id")
def change_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty notes that aren't deleted, as one pack a device."""
    kept = table(spark, sf_dir, "events").filter("value > 90 and event_type <> 'view'").groupBy("user_id")
    return kept.agg(F.count(F.lit(1)).alias("notes"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: i.cast("string")), ",").alias("ids"))


@query("cache_lookup", """WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0) SELECT e.event_type, count(*) FILTER (k.user_id IS NOT NULL) AS hits, count(*) FILTER (k.user_id IS NULL) AS misses
FROM events e LEFT JOIN k ON e.user_id = k.user_id AND e.event_type = k.event_type WHERE e.event_id % 2 = 1 GROUP BY 1""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a keyed cache."""
    e = table(spark, sf_dir, "events")
    cached = e.filter("event_id % 2 = 0").select("user_id", "event_type").distinct().withColumn("hit", F.lit(True))
    found = e.filter("event_id % 2 = 1").join(cached, ["user_id", "event_type"], "left").groupBy("event_type")
    return found.agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("cache_filled", """WITH k AS (SELECT user_id, max(event_id) AS latest FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT user_id, max(event_id) AS latest FROM events GROUP BY 1)
SELECT e.event_type, count(k.user_id) AS hits, count(*) - count(k.user_id) AS misses, sum(coalesce(k.latest, m.latest))::BIGINT AS contents FROM events e LEFT JOIN k ON e.user_id = k.user_id JOIN m ON e.user_id = m.user_id GROUP BY 1""")
def cache_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed cache that the purchases fill; all events look theirs up, misses
    are computed and stored, and every event reads its content."""
    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    cache.create(spark, root, "latest bigint", buckets=32)
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", cache.key([F.col("user_id")], "latest-1").alias("key"))
    content = lambda rows: lambda wanted: wanted.select("key").join(rows.groupBy("key").agg(F.max("event_id").alias("latest")), "key")
    bought = e.filter("event_type = 'purchase'")
    cache.fill(bought.select("key"), root, content(bought), 1.0)
    asked = e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))
    met = written(cache.lookup(asked, root).select("key", "hit"), "cache-hits")
    cache.fill(asked.select("key"), root, content(e), 2.0)
    found = asked.join(met, "key").join(cache.lookup(asked, root).select("key", "latest"), "key").groupBy("event_type")
    hits = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return found.agg(hits.alias("hits"), (F.sum("n") - hits).alias("misses"), F.sum(F.col("n") * F.col("latest")).alias("contents"))


@query("corrupt_rows", """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'corrupt' WHEN json_extract(props, '$.k') IS NULL THEN 'empty' ELSE 'ok' END AS state, CASE WHEN event_id % 6 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events""")
def corrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON reading: corrupt rows are set apart, the others parsed."""
    from quire.sources.json_rows import classified

    props = F.when(F.col("event_id") % 6 == 0, F.left(F.col("props"), F.lit(3))).otherwise(F.col("props"))
    return classified(table(spark, sf_dir, "events").select("event_id", props.alias("json")), "json", "k bigint").select("event_id", "state", F.col("parsed.k").alias("k"))


PARTS = {"push": "manifest_push", "pull": "manifest_pull", "remote": "remote_scan"}


def _sync_sql() -> str:
    one = [f"SELECT '{c}' AS channel, action AS outcome, count(*) AS n FROM ({ORACLES[q]}) GROUP BY action" for c, q in PARTS.items()]
    one.append(f"SELECT 'notes' AS channel, outcome, count(*) AS n FROM ({ORACLES['three_way_notes']}) GROUP BY outcome")
    one.append(f"SELECT 'annotations' AS channel, 'kept' AS outcome, count(*) AS n FROM ({ORACLES['annotations_lww']})")
    one.append(f"SELECT 'snapshots' AS channel, 'pages' AS outcome, count(*) AS n FROM ({ORACLES['snapshot_pages']})")
    return " UNION ALL ".join(one)


@query("sync_report", _sync_sql())
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels of a sync, by outcome."""
    channels = {"push": manifest_push, "pull": manifest_pull, "remote": remote_scan}
    parts = [f(spark, sf_dir).select(F.lit(c).alias("channel"), F.col("action").alias("outcome")) for c, f in channels.items()]
    parts.append(three_way_notes(spark, sf_dir).select(F.lit("notes").alias("channel"), "outcome"))
    parts.append(annotations_lww(spark, sf_dir).select(F.lit("annotations").alias("channel"), F.lit("kept").alias("outcome")))
    parts.append(snapshot_pages(spark, sf_dir).select(F.lit("snapshots").alias("channel"), F.lit("pages").alias("outcome")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("n"))
