"""Rendered notes, versioned tables and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import identity
from quire.functions import text as T


def front_matter_block(pairs: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), T.yaml_quoted(v.cast("string"))) for k, v in pairs.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def literature_cards(papers: DataFrame) -> DataFrame:
    """path, text of a card a paper (title, authors, year, category, abstract)."""
    name = F.concat_ws("_", F.col("year").cast("string"), identity.file_name(F.col("title")))
    meta = front_matter_block({c: F.col(c) for c in ("title", "authors", "year", "category")})
    text = F.concat(meta, F.lit("\n# "), F.col("title"), F.lit("\n\n## Abstract\n\n"), F.coalesce("abstract", F.lit("")), F.lit("\n"))
    return papers.select(F.concat(F.lit("01_Literature/"), F.col("category"), F.lit("/"), F.left(name, F.lit(80)), F.lit(".md")).alias("path"), text.alias("text"))


def bibtex(papers: DataFrame) -> DataFrame:
    """Adds bibtex: an entry with a key of first author, year and first title word."""
    author = F.regexp_replace(F.lower(F.regexp_extract("authors", r"^([^,;]*?)(\S+)\s*(?:[,;]|$)", 2)), "[^a-z]", "")
    word = F.regexp_extract(F.lower("title"), "([a-z]{3,})", 1)
    field = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), c, F.lit("}")))
    fields = F.concat_ws(",\n", field("title", F.col("title")), field("author", F.regexp_replace("authors", r"\s*[,;]\s*", " and ")), field("year", F.col("year").cast("string")), field("doi", F.col("doi")))
    return papers.withColumn("bibtex", F.concat(F.lit("@article{"), author, F.col("year").cast("string"), word, F.lit(",\n"), fields, F.lit("\n}")))


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Writes a version once: an existing one stays, so a repeated batch changes
    nothing; readers see whole versions only, by Spark's commit."""
    path = f"{folder}/v={version:012d}"
    df.write.mode("ignore").parquet(path)
    return path


def change_pack(notes: DataFrame, only_dirty: bool = True) -> DataFrame:
    """One JSON pack a device of notes (device, id, title, body, base_hash, dirty, deleted)."""
    kept = notes.filter(~F.col("deleted") & (F.col("dirty") | F.lit(not only_dirty)))
    note = F.struct("id", "title", "body", F.col("base_hash").alias("baseHash"))
    pack = kept.groupBy("device").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    return pack.select("device", F.to_json(F.struct(F.lit("notes-pack").alias("format"), F.lit(1).alias("version"), "notes")).alias("json"))
