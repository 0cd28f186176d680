"""File sources: notes, catalogues and manifests from a folder of any store Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import identity
from quire.functions import text as T

PDF_MAGIC = "255044462D"
MOST_BYTES = 40 * 1024 * 1024


def relative(path: Column, root: str) -> Column:
    """A file's path below the folder it was read from."""
    name = root.rstrip("/").split("/")[-1]
    return F.regexp_replace(path, rf"^.*?{'/' if name else ''}{_quoted(name)}/", "")


def _quoted(s: str) -> str:
    return rf"\Q{s}\E"


def notes(spark: SparkSession, root: str) -> DataFrame:
    """path, title, folder, body, meta, mtime of all Markdown notes in content
    folders. Files that aren't UTF-8 are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return parsed(files.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("mtime")))


def parsed(rows: DataFrame) -> DataFrame:
    """Notes of rows (path, raw, mtime), wherever they were read. Null and
    undecodable texts are left out; repeated paths stay repeated."""
    rows = rows.filter(identity.in_vault(F.col("path")) & F.is_valid_utf8("raw") & ~F.substring_index("path", "/", -1).startswith("."))
    meta = T.front_matter(F.col("raw"))
    body = F.regexp_replace("raw", r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.md$", "")
    rows = rows.withColumn("meta", meta).withColumn("body", body)
    title = F.coalesce(F.nullif(F.try_element_at("meta", F.lit("title")), F.lit("")), F.nullif(T.first_heading(F.col("body")), F.lit("")), stem)
    return rows.select("path", title.alias("title"), F.substring_index("path", "/", 1).alias("folder"), "body", "meta", "mtime")


def pdf_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """path, name, stem, topic, size, mtime of PDF files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    return files.select(*_catalogued(root))


def _catalogued(root: str) -> list[Column]:
    path = relative(F.col("path"), root)
    name = F.substring_index(path, "/", -1)
    return [path.alias("path"), name.alias("name"), F.regexp_replace(name, r"(?i)\.pdf$", "").alias("stem"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")).alias("topic"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]


def _checked() -> list[Column]:
    pdf = F.hex(F.substring("content", 1, 5)) == PDF_MAGIC
    reason = F.when(F.col("length") > MOST_BYTES, "too large").when(~pdf, "not a PDF")
    return [reason.isNull().alias("accepted"), reason.alias("reason")]


def uploads(spark: SparkSession, root: str) -> DataFrame:
    """path, size, accepted, reason: files within the size limit that begin as a PDF does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), *_checked())


def checked_catalogue(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """The columns of `pdf_catalogue` with accepted and reason of `uploads`: files are
    listed once, and nothing is joined. Spark deals some 32 small files to a task;
    with `tasks` neighbours are read by one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    found = files.select(*_catalogued(root), *_checked())
    return found if tasks is None else found.coalesce(tasks)


def folders(catalogue: DataFrame) -> DataFrame:
    """Distinct parent folders that aren't hidden."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return catalogue.select(parent.alias("folder")).filter(~F.col("folder").rlike(r"(^|/)\.")).distinct()


def listing_fingerprint(catalogue: DataFrame) -> DataFrame:
    """One row: files, bytes and an order-free digest of (path, size, mtime), so nothing is gathered."""
    h = F.xxhash64("path", "size", F.unix_micros("mtime")).cast("decimal(38,0)")
    return catalogue.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(h).alias("digest"))
