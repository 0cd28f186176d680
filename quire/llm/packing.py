"""Packing documents into sequences of a token budget by minimum bin slack.

Per sequence, a subset-sum dynamic programme over the lengths still available,
with a bit for every reachable sum, finds the fullest feasible combination; it
is then removed. A combination holds again as long as each of its lengths is
left often enough, so it is removed as many times at once. What the programme
sees is the number of pieces of each length, at most `budget` numbers whatever
the size of the corpus; pieces find their places by their rank among the pieces
of their length, in Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.bpe import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, largest first, of a combination of available pieces whose sum is
    the largest up to capacity."""
    bits, mask, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted((k for k, n in counts.items() if n and k <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            grown = (bits | bits << length) & mask
            if grown == bits:
                break
            steps.append((length, bits))
            bits = grown
        if bits >> capacity & 1:
            break
    total, chosen = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return sorted(chosen, reverse=True)


def plan(histogram: dict[int, int], budget: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), using every piece once.

    The largest length left is always part of the next sequence, so that no
    long piece stays to the end.
    """
    left, made = {k: n for k, n in histogram.items() if n}, []
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        lengths = [first, *fullest(rest, budget - first)]
        times = min(left[k] // lengths.count(k) for k in set(lengths))
        for k in lengths:
            left[k] -= times
        left = {k: n for k, n in left.items() if n}
        made.append((lengths, times))
    return made


def pieces(docs: DataFrame, tokenizer: str, budget: int, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. Only
    documents over the budget are cut, at every `budget` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * budget)):
                    part = ids[at : at + 4 * budget]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(cut: DataFrame, budget: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to budget.

    `cut` is read three times and should be a stored table. Driver: at most
    `budget` counts and the combinations made of them.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for lengths, times in plan(histogram, budget):
        offset = 0
        for k in lengths:
            slots.append((k, used[k], sequence, offset))
            used[k] += times
            offset += k
        sequence += times
    slots.sort()
    length, first, base, offset = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else ((),) * 4))
    keys = (length << 44) + first  # a slot serves the ranks from its first one to the next slot's

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        asked = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, (asked[0] << 44) + asked[1], side="right") - 1
        return pd.DataFrame({"sequence_id": base[at] + asked[1] - first[at], "offset": offset[at]})

    names = cut.columns
    spread = F.struct(*[n for n in ("doc_id", "piece", "ids_crc32") if n in names] or names)
    ranked = common.with_rank(cut, ["length"], [F.col(n) for n in names], spread, "_rank", buckets=256)
    return ranked.withColumn("_at", place("length", "_rank")).select(*names, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, budget: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A null text counts as empty, a piece of end_id alone; repeated rows are
    pieces of their own; an empty table gives no rows. Other columns are not
    read.
    """
    cut = common.written(pieces(docs, tokenizer, budget, end_id), "pieces")
    return pack(cut, budget)
