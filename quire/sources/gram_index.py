"""A stored index of notes for keyword search: which notes hold which three characters.

    gram_index.add(notes, root)                         # path, title, tags, category, body[, deleted]
    gram_index.search(spark, root, "curve snapshot")    # as operators.retrieval.search

A part holds its notes in folders by bucket of the path's hash, and postings
(gram, note) in segments sorted by gram, so that a gram is looked up by the ranges
of their pages. A question reads the postings of its grams, then the buckets of the notes
that have all grams of one of its words; those notes are scored on their texts,
so an index never changes a result. Each position begins a gram (texts end in two
NULs), so a word of one or two characters is a prefix of grams.

A later part replaces the notes of its paths; `deleted` rows remove theirs. Rows
of one path in one part all stay. A null path is a path like others; null fields
are empty. A numbered file of `_versions` lists the parts and is made in one step.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import retrieval
from quire.sources import vault

FIELDS = ("path", "title", "tags", "category", "body")
STORED = "path string, title string, tags string, category string, body string, note bigint, _seq int, _deleted boolean, _bucket int"
BUCKETS = 1024
PIECE = 4096
TRIES = 8


def latest(root: str) -> tuple[int, dict]:
    """The last version and what it lists."""
    fs, base = vault.opened(root)
    known = vault.versions(fs, base)
    return (known[-1], vault.content(fs, base, known[-1])) if known else (0, {"parts": []})


def grams(fields: list[Column]) -> Column:
    """The distinct grams of a note, in lower case. They are cut from pieces that
    overlap by two characters, in time linear in the text."""
    text = F.concat(F.lower(F.concat_ws("\n", *fields)), F.lit("\0\0"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit("(?s)(?=(...))."), F.lit(1))))))


def _part(notes: DataFrame, root: str, seq: int, buckets: int) -> dict:
    """Writes the notes and postings of a part; what a version lists of it."""
    spark, name = notes.sparkSession, uuid.uuid4().hex
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in notes.columns else F.lit(False)
    rows = notes.select(*[F.col(c).cast("string").alias(c) for c in FIELDS], F.xxhash64(F.col("path").cast("string")).alias("note"), F.lit(seq).alias("_seq"), gone.alias("_deleted"))
    rows = rows.withColumn("_bucket", F.pmod("note", F.lit(buckets)).cast("int")).withColumn("_chance", F.rand(11))
    # tasks of even size: a large bucket or a path of very many rows is several files
    even = rows.repartitionByRange("_bucket", "note", "_chance").drop("_chance").sortWithinPartitions("_bucket", "note")
    even.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{root}/notes/_part={name}")
    kept = _notes(spark, root, [name]).filter(~F.col("_deleted"))
    posted = kept.select(F.explode(grams([F.col(c) for c in FIELDS[1:]])).alias("gram"), "note")
    # a segment for each task's notes: postings aren't shuffled, and a lookup reads a few pages of each segment
    posted.sortWithinPartitions("gram", "note").write.option("compression", "zstd").parquet(f"{root}/grams/_part={name}")
    return {"name": name, "rows": _notes(spark, root, [name]).count()}


def _notes(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    return spark.read.schema(STORED).option("basePath", f"{root}/notes").parquet(*[f"{root}/notes/_part={n}" for n in names])


def add(notes: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Adds a part; the version that holds it. The first call sets the number of buckets."""
    root = root.rstrip("/")
    fs, base = vault.opened(root)
    for _ in range(TRIES):
        version, log = latest(root)
        log.setdefault("buckets", buckets)
        log["parts"].append(_part(notes, root, version + 1, log["buckets"]))
        try:
            vault.publish(fs, base, version + 1, log)
            return version + 1
        except vault.VersionConflict:
            for kind in ("notes", "grams"):
                fs.delete_dir(f"{base}/{kind}/_part={log['parts'][-1]['name']}")
    raise vault.VersionConflict(f"{TRIES} other writers were first")


def candidates(spark: SparkSession, root: str, question: str) -> DataFrame:
    """note: hashes of paths of notes with all grams of a word of the question, in
    any part. Every note that holds a word is among them."""
    _, log = latest(root)
    rows = spark.read.schema("gram string, note bigint").parquet(*[f"{root.rstrip('/')}/grams/_part={p['name']}" for p in log["parts"]])
    gram, asked = F.col("gram"), {}
    for w in dict.fromkeys(question.lower().split()):
        asked[w] = [gram.startswith(w)] if len(w) < 3 else [gram == g for g in dict.fromkeys(w[i : i + 3] for i in range(len(w) - 2))]
    exact = sorted({w[i : i + 3] for w in asked for i in range(len(w) - 2)})
    wanted = [gram.isin(exact)] if exact else []
    wanted += [gram.startswith(w) for w in asked if len(w) < 3]
    has = [reduce(and_, [F.bool_or(c) for c in tests]) for tests in asked.values()]
    return rows.filter(reduce(or_, wanted, F.lit(False))).groupBy("note").agg(reduce(or_, has, F.lit(False)).alias("has")).filter("has").select("note")


def fetched(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """The stored notes of these hashes, in their newest version, without deleted ones.

    The driver learns how many candidates each bucket has, at most a number for
    each of the index's buckets, and only those folders are read. Where most
    stored notes are candidates the others of these folders come along: scoring
    leaves them out at less cost than a join that moves nearly all texts.
    """
    root, (_, log) = root.rstrip("/"), latest(root)
    names, bucket = [p["name"] for p in log["parts"]], F.pmod("note", F.lit(log["buckets"])).cast("int")
    met = {r["b"]: r["n"] for r in found.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _notes(spark, root, names).filter(F.col("_bucket").isin(list(met)))
    if 2 * sum(met.values()) < sum(p["rows"] for p in log["parts"]):
        rows = rows.join(found, "note", "left_semi")
    if len(names) > 1:
        newest = rows.groupBy(F.col("path").alias("_path")).agg(F.max("_seq").alias("_newest"))
        rows = rows.join(newest, F.col("path").eqNullSafe(F.col("_path")) & (F.col("_seq") == F.col("_newest")), "left_semi")
    return rows.filter(~F.col("_deleted")).select(*FIELDS)


def search(spark: SparkSession, root: str, question: str, top_k: int = 5, snippet_chars: int = 400) -> DataFrame:
    """As `retrieval.search` over all notes that stand, reading those that hold the
    grams of a word. A question without words finds nothing, as does an index without parts."""
    if not question.split() or not latest(root)[1]["parts"]:
        return retrieval.search(spark.createDataFrame([], STORED).select(*FIELDS), question, top_k, snippet_chars)
    return retrieval.search(fetched(spark, root, candidates(spark, root, question)), question, top_k, snippet_chars)
