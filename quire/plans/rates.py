"""Rate, cache and statistics queries on events by user and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rates
from quire.plans.registry import query
from quire.session import table


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", rates.seconds("ts"))


@query("fired_recently", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def fired_recently(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same key in the day up to each one."""
    return rates.counts_within(timed(spark, sf_dir).select("event_id", "user_id", "at"), "user_id", "at", 86400.0, 7 * 86400.0).select("event_id", "recent")


@query("request_windows", """WITH w AS (SELECT user_id, unnest([0, 1, 2]) AS k, epoch_us(ts) // 1000000 AS s FROM events) SELECT user_id, ((s // 3600 - k) * 3600)::BIGINT AS start, count(*) AS n FROM w GROUP BY 1, 2""")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by sliding window of three hours, each hour."""
    w = timed(spark, sf_dir).groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


@query("throttled", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS tt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, round(max(tt - n * 3600.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY n) + n * 3600.0::DOUBLE, 3) AS slot FROM e""")
def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.throttled(timed(spark, sf_dir).select("event_id", "user_id", "at"), "user_id", "at", ["at", "event_id"], 3600.0)
    return rows.select("event_id", F.round("slot", 3).alias("slot"))


#: Requests of a user one after the other, each with the slots of the last day before it.
LIMITER = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS tt, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, n, tt, tt AS slot, [tt] AS held FROM e WHERE n = 1
 UNION ALL SELECT user_id, n, tt, slot, list_append(kept, slot) FROM (SELECT e.user_id, e.n, e.tt, list_filter(r.held, lambda s: s > e.tt - 86400) AS kept,
  greatest(e.tt, coalesce(kept[-1] + 600, e.tt), CASE WHEN len(kept) >= 9 THEN kept[{which}] + 86400 ELSE e.tt END) AS slot FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, tt AS "at", slot FROM r"""


@query("limiter_as_read", LIMITER.format(which=1))
def limiter_as_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.limited(timed(spark, sf_dir), "user_id", "at", 9, 86400.0, 600.0)


@query("limiter_strict", LIMITER.format(which=-9))
def limiter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.limited(timed(spark, sf_dir), "user_id", "at", 9, 86400.0, 600.0, strict=True)


@query("lru_kept", """WITH u AS (SELECT user_id, event_type, max(event_id) AS used FROM events GROUP BY 1, 2) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY used DESC) <= 64""")
def lru_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 64 entries a model holds after all accesses."""
    used = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("used"))
    return rates.newest(used, ["event_type"], [F.desc("used")], 64)


@query("pruned_files", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' - INTERVAL 400 DAY AND o_orderdate < TIMESTAMP '1999-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""")
def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an age limit and then a number of files leave, by folder."""
    o = table(spark, sf_dir, "orders")
    now = F.lit("1999-01-01").cast("timestamp_ntz")
    young = o.filter((F.col("o_orderdate") < now) & (F.col("o_orderdate") >= now - F.expr("INTERVAL 400 DAYS")))
    return rates.newest(young, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("note_histories", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def note_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest versions of each note, first in first out."""
    return rates.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 5)


@query("cache_keys", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey || '|5|2') AS key FROM orders")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of derived data: what it comes from, and the versions of what made it."""
    part = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("5"), F.lit("2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(part.cast("binary"), 256).alias("key"))


@query("vault_counts", """SELECT lang, count(*) AS notes, sum(len(regexp_extract_all(text, '(?:^|\\n)[A-Z][a-z]+ing\\b')))::BIGINT AS headings, count(*) FILTER (n_chars > 2000) AS long_notes FROM documents GROUP BY lang""")
def vault_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"(?:^|\n)[A-Z][a-z]+ing\b"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("notes"), F.sum(n).cast("long").alias("headings"), F.count_if(F.col("n_chars") > 2000).alias("long_notes"))


@query("weekly_report", """WITH k AS (SELECT * FROM orders WHERE o_orderdate::DATE >= DATE '1995-06-30' - 7) SELECT o_orderpriority, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM k GROUP BY 1""")
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from a week before a given day on (without an upper bound), and the latest."""
    kept = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").cast("date") >= F.date_sub(F.lit("1995-06-30").cast("date"), 7))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("navigation", """WITH d AS (SELECT *, coalesce(doc_id % 7 = 0, false) AS deleted FROM documents) SELECT source, doc_id, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 9 END AS rank FROM d WHERE NOT deleted AND contains(lower(text), 'ering')""")
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped listing: fixed folders first, other groups by name, entries by title;
    entries marked as deleted are left out."""
    d = table(spark, sf_dir, "documents").withColumn("deleted", F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False)))
    return listed(d.filter(~F.col("deleted") & F.contains(F.lower("text"), F.lit("ering"))))


def listed(d: DataFrame) -> DataFrame:
    rank = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(9)
    return d.select("source", "doc_id", rank.alias("rank")).orderBy("rank", "source", "doc_id")


@query("size_gates", """SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1000 THEN 'whole' WHEN octet_length(encode(text)) <= 5000 THEN 'core' ELSE 'rejected' END AS gate FROM documents""")
def size_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(size <= 1000, "whole").when(size <= 5000, "core").otherwise("rejected").alias("gate"))


@query("model_health", """WITH RECURSIVE k AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS tt, CASE event_type WHEN 'click' THEN 'quota' WHEN 'purchase' THEN 'no_output' WHEN 'view' THEN 'recovered' ELSE 'check' END AS event FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tt, event) AS n FROM k),
r AS (SELECT user_id, 0::BIGINT AS n, 0::DOUBLE AS tt, '' AS event, '' AS kind, 0::DOUBLE AS lasts, 0::DOUBLE AS probed, false AS probe FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, n, tt, event, kind, lasts, CASE WHEN kind <> '' AND tt - seen >= 900 THEN tt ELSE seen END, kind <> '' AND tt - seen >= 900 FROM (
  SELECT user_id, n, tt, event, CASE WHEN event = 'recovered' THEN '' WHEN event <> 'check' THEN event WHEN ended THEN '' ELSE kind END AS kind,
   CASE WHEN event = 'recovered' THEN 0 WHEN event = 'no_output' THEN tt + 60 WHEN event <> 'check' OR ended THEN 0 ELSE lasts END AS lasts, CASE WHEN event <> 'check' OR ended THEN tt ELSE probed END AS seen
  FROM (SELECT e.*, r.kind, r.lasts, r.probed, r.kind <> '' AND r.lasts > 0 AND e.tt >= r.lasts AS ended FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id, tt AS "at", event, kind <> '' AS degraded, kind, probe FROM r WHERE n > 0""")
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as models, event types as their errors and recoveries."""
    kind = F.when(F.col("event_type") == "click", "quota").when(F.col("event_type") == "purchase", "no_output").when(F.col("event_type") == "view", "recovered").otherwise("check")
    return rates.health(timed(spark, sf_dir).select("user_id", "at", kind.alias("event")), "user_id")
