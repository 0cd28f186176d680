"""Tolerant and strict reading of JSON documents held in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classified(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds parsed (by `schema`) and state: ok, empty (no field of the schema) or
    corrupt (not JSON), for routing corrupt rows to a table of their own."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(column, f"{schema}, _corrupt string", options)
    fields = [f.split()[0] for f in schema.split(",")]
    out = df.withColumn("_j", parsed)
    empty = F.lit(True)
    for f in fields:
        empty = empty & F.col(f"_j.{f}").isNull()
    state = F.when(F.col(column).isNull() | F.col("_j._corrupt").isNotNull(), "corrupt").when(empty, "empty").otherwise("ok")
    return out.withColumn("state", state).withColumn("parsed", F.struct(*[F.col(f"_j.{f}").alias(f) for f in fields])).drop("_j")


def tolerant(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds parsed; a missing or corrupt document is null."""
    return classified(df, column, schema).withColumn("parsed", F.when(F.col("state") != "corrupt", F.col("parsed"))).drop("state")


def accepted_packs(packs: DataFrame, tag: str) -> DataFrame:
    """Notes of change packs (pack_id, json). A pack counts as a whole or not at
    all: its format tag must match and every element must be an object."""
    outer = F.from_json("json", "format string, notes array<string>")
    rows = packs.withColumn("_p", outer).filter(F.col("_p.format") == tag)
    objects = F.forall("_p.notes", lambda n: F.coalesce(n.rlike(r"^\s*\{"), F.lit(False)))
    note = "id string, title string, body string, baseHash string, mtime bigint"
    return rows.filter(F.coalesce(objects, F.lit(False))).select("pack_id", F.posexplode("_p.notes").alias("pos", "_n")).select("pack_id", "pos", F.from_json("_n", note).alias("note")).select("pack_id", "pos", "note.*")
