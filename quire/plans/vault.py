"""Documents as the files of a vault: scanned, catalogued and watched.

Each query writes the whole table as files of its own new vault below the shared
folder, by the two-step writer, and reads those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.session import table
from quire.sources import files, vault
from quire.sources.tables import shared_dir
from quire.streaming import flows

FOLDERS = ("01_Literature", "03_Knowledge", "logs")
PATHS = f"""n AS (SELECT doc_id, {list(FOLDERS)}[1 + doc_id % 3] || '/T' || doc_id % 7 || '/' || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'n' || doc_id AS stem,
 coalesce('# Note ' || doc_id || chr(10) || text, '') AS body, text FROM documents)"""


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stem, text: some in a folder that isn't content, some hidden."""
    d = F.col("doc_id")
    top = F.get(F.array(*map(F.lit, FOLDERS)), (d % 3).cast("int"))
    stem = F.concat(top, F.lit("/T"), (d % 7).cast("string"), F.lit("/"), F.when(d % 11 == 0, ".").otherwise(""), F.lit("n"), d.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), "text")


def as_notes(spark: SparkSession, sf_dir: str) -> str:
    """The root of a new vault of notes and other files."""
    root = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}"
    d = F.col("doc_id")
    ending = F.when(d % 13 == 0, ".txt").otherwise(".md")
    vault.save(stems(spark, sf_dir).select(F.concat("stem", ending).alias("path"), F.concat(F.lit("# Note "), d.cast("string"), F.lit("\n"), "text").alias("text")), root, expected=0)
    return root


@query("vault_notes", f"""WITH {PATHS} SELECT stem || '.md' AS path, split_part(stem, '/', 1) AS folder, CASE WHEN text IS NULL THEN split_part(stem, '/', 3) ELSE 'Note ' || doc_id END AS title, md5(body) AS digest
FROM n WHERE doc_id % 3 < 2 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the content folders; others aren't listed."""
    rows = vault.load(spark, as_notes(spark, sf_dir)).filter(F.col("folder").isin(*FOLDERS[:2]))
    found = files.parsed(rows.select("path", F.col("text").alias("raw"), F.timestamp_micros(F.floor(F.col("mtime") / 1000)).alias("mtime")))
    return found.select("path", "folder", "title", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("vault_catalogue", f"""WITH {PATHS} SELECT stem || '.pdf' AS path, split_part(stem, '/', 3) AS stem, split_part(stem, '/', 2) AS topic, (strlen(coalesce(text, '')) + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 9 END)::BIGINT AS size,
doc_id % 4 <> 0 AS accepted FROM n WHERE doc_id % 11 <> 0""")
def vault_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all topics, without their contents, and which of them begin as a PDF does."""
    root = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}"
    magic = F.when(F.col("doc_id") % 4 == 0, "").otherwise("%PDF-1.4\n")
    vault.save(stems(spark, sf_dir).select(F.concat("stem", F.lit(".pdf")).alias("path"), F.concat(magic, F.coalesce("text", F.lit(""))).alias("text")), root)
    held = vault.described(root)
    tasks = max(2 * spark.sparkContext.defaultParallelism, held["files"] // 2048, held["bytes"] >> 26)
    return files.checked_catalogue(spark, vault.folder(root), tasks).select("path", "stem", "topic", "size", "accepted")


@query("watched_notes", f"""WITH {PATHS} SELECT stem || '.md' AS path, strlen(body)::BIGINT AS size, md5(body) AS digest, 1::BIGINT AS seen FROM n WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def watched_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watcher looks twice at the same files, and hands on each of them once."""
    root = as_notes(spark, sf_dir)
    schema = "path string, size bigint, digest string"
    for _ in range(2):
        stream = vault.watch(spark, root, f"{root}-log").select("path", "size", F.md5(F.col("text").cast("binary")).alias("digest"))
        flows.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}-seen/batch={n}"), f"{root}-checkpoint")
    return spark.read.schema(schema).parquet(f"{root}-seen").groupBy(*[c.split()[0] for c in schema.split(", ")]).agg(F.count(F.lit(1)).alias("seen"))
