"""Streaming variants: folder watching, keyed merges, windows, limiters.

Watermarks and how long tombstones are remembered are this library's own
policies: late rows beyond the watermark are dropped by Spark, and a merge keeps
every tombstone in its table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import rates
from quire.sources import keyed_log


def watch(spark: SparkSession, folder: str, schema: str, file_format: str = "json") -> DataFrame:
    """New files of a folder, each once; Spark's checkpoint is the list of those seen."""
    return spark.readStream.schema(schema).format(file_format).option("recursiveFileLookup", "true").load(folder)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles what is there and stops. A batch that fails isn't marked as seen and comes again."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lww_upserts(target: str, key: str, stamp: str, horizon: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps the newest row of each key in a log under
    `target` (`sources.keyed_log`): a batch writes its own rows, not the table's.
    Rows with deleted = true stand as tombstones, until merges find their stamp
    below `horizon`. A batch that comes again changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed_log.upsert(batch, target, key, stamp, batch_id=batch_id, horizon=horizon)

    return handle


def request_counts(requests: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Requests of each key by sliding window, in append mode under a watermark."""
    return requests.withWatermark(at, late).groupBy(F.window(at, width, slide), key).agg(F.count(F.lit(1)).alias("n"))


class Limiter(StatefulProcessor):
    """Slots of requests (key, at) by the limiter's rule; state is the slots of one width."""

    def __init__(self, most: int, width: float, gap: float, strict: bool = False):
        self.rule = (most, width, gap, strict)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getValueState("slots", "slots array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        slots = list(self.slots.get()[0]) if self.slots.exists() else []
        for b in rows:
            b = b.sort_values("at")
            out = [rates.reserve(t, slots, *self.rule) for t in b["at"]]
            yield pd.DataFrame({"key": b["key"], "at": b["at"], "slot": out})
        self.slots.update((slots,))

    def close(self) -> None:
        pass


def limited(requests: DataFrame, most: int, width: float, gap: float, strict: bool = False) -> DataFrame:
    """key, at, slot of a stream of requests (key string, at double)."""
    return requests.groupBy("key").transformWithStateInPandas(Limiter(most, width, gap, strict), "key string, at double, slot double", "Append", "None")
