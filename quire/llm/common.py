"""Helpers shared by the operators: shared storage, distributed ranks, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Folders made where none is named, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is
    unset and everything runs on this machine (tests), a new one in its
    temporary folder. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        found = _own[context.applicationId]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, out: str, buckets: int = 64) -> DataFrame:
    """Gapless ranks from 0 within each group, without sorting a group in one task.

    Rows of a group are dealt over buckets by `spread`; ranks run within a
    bucket and start at the sum of the counts of the buckets before it. The
    table of counts has at most `buckets` rows a group.
    """
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = keyed.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(starts, same).withColumn(out, (F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_gb", "_start", "_r", *[f"_g{i}" for i in range(len(group))])
