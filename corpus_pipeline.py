"""A corpus pipeline of four stages, each written as Parquet and reread.

Language identification drops documents without a language, near-duplicates
keep one document of each group, personal data is replaced in the texts, and
what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, langid, neardup, packing, pii
from quire.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BUDGET = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in learned languages, also in several of them, with the
    language that was found as their `lang`.

    A null text or one without letters has none. Others need the evidence that
    is calibrated on the training sample (`langid.calibrate`): the share of
    character features known from training must be nearer to that of training
    documents than to that of random letters.
    """
    model = langid.fit(docs)
    found = langid.predict(docs, model, COLUMNS, evidence=True)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("evidence") >= model.least)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the smallest doc_id, rows without
    an id last, and of the smallest hash of the text among rows of that id. Texts
    without words are linked with nothing. Of rows of one doc_id and one text,
    whether linked or not, the first by lang, source and n_chars stays.
    """
    # rows meet by id and text, so that one kept row without an id doesn't keep all of them
    kept = neardup.near_duplicate_rows(docs).filter("stays").select(F.struct("doc_id", "key").alias("_kept")).distinct()
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key")).alias("_row"))
    found = rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    return found.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.lang", "r.source", "r.n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span in the text and counts its characters anew; keeps all
    documents. A null text stays null, with a null n_chars; texts without spans
    and other columns are left as they are."""
    found = pii.find_spans(docs, tuple(COLUMNS))
    return pii.redacted(found, "text", "spans").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most BUDGET tokens, a row a piece.

    A null or empty text is its end token alone. Repeated rows and null ids are
    documents of their own; texts of more than BUDGET tokens are cut, at any
    length. An empty table gives no rows, and other columns are not read.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), BUDGET)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packed", packed)]

#: No SQL for a conditional random field or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
