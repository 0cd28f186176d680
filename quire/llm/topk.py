"""Exact top-k search by integer inner product on an impact-ordered index.

Components are quantised into impacts: the first posting segment of a block
holds each component rounded to a multiple of a large power of two, the next
the rest rounded to a multiple of a quarter of that, down to ones, after which
nothing is left. So segments hold digits of descending impact, postings of the
digit 0 are not scored, and the sum of all segments is the vector.

A query adds up segments from the highest impact down, score at a time. What
the segments not yet added can change is bounded for each row by the
Cauchy-Schwarz inequality on the norm of its rest, which the index holds. A
query stops as soon as these bounds prove that few rows can be among its best;
exactly those are scored in full, from their digits, in whole numbers. Without
such a proof it goes on through the last segment, after which every score is
complete, so results never depend on how well bounds work.

Rows are dealt evenly over blocks without regard to their values, so the first
block is a fair sample. Every query meets it first, and its k-th best score
there is a proven lower bound that it carries to all other blocks: a block none
of whose vectors is long enough to reach the bound of a query doesn't get
that query, rows whose bound is lower are never rescored, and most queries stop
before the last segment. Queries and blocks of the index meet by
block number in sorted streams, so a task holds one block and some queries
at a time, and a block returns its k best per query at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common

INDEX_ROWS, QUERY_ROWS = 4096, 512
#: Tasks that blocks of the index are dealt to at most.
MOST_TASKS = 4096
#: Each segment's impact is this part of the one before.
FINER = 4
#: Possible members a query may keep for rescoring, as a fraction of the block's rows.
POSSIBLE = 1 / 16
#: A segment of a smaller share of digits other than 0 is kept as postings by component.
SPARSE = 1 / 16
#: Vectors of at least this norm could have scores beyond 64 bits.
MOST_NORM = 2.0**31
SEGMENT = pa.struct([("step", pa.int64()), ("rows", pa.binary()), ("parts", pa.binary()), ("digits", pa.binary()), ("rest", pa.binary())])
ARROW_INDEX = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("named", pa.binary()), ("longest", pa.float64()), ("segments", pa.list_(SEGMENT))])
INDEX = "block int, n int, width int, ids binary, named binary, longest double, segments array<struct<step:long,rows:binary,parts:binary,digits:binary,rest:binary>>"


def matrix(values: list[bytes]) -> np.ndarray:
    """Rows of integers from their bytes; shorter vectors end in zeros."""
    parts = [np.frombuffer(v, "<i8") for v in values]
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out


def build(ids: list, values: np.ndarray) -> dict:
    """The impact-ordered index of a block, in the columns of INDEX but for the block's number."""
    top = int(np.abs(values).max(initial=0))
    step = 1 << max(0, top.bit_length() - 2)
    rest, segments = values, []
    while True:
        digits = (rest + (step >> 1)) // step
        rest = rest - digits * step
        held = {"step": step, "rows": None, "parts": None, "digits": digits.astype(np.int8).tobytes(), "rest": np.sqrt((rest.astype(float) ** 2).sum(1)).astype("<f8").tobytes()}
        if np.count_nonzero(digits) < SPARSE * digits.size:
            parts, rows = np.nonzero(digits.T)
            held |= {"rows": rows.astype("<i4").tobytes(), "parts": parts.astype("<i4").tobytes(), "digits": digits[rows, parts].astype(np.int8).tobytes()}
        segments.append(held)
        if step == 1:
            break
        step = max(1, step // FINER)
    named = np.array([i is not None for i in ids])
    numbers = np.array([0 if i is None else i for i in ids], "<i8")
    return {"n": len(ids), "width": values.shape[1], "ids": numbers.tobytes(), "named": named.tobytes(), "longest": float(np.sqrt((values.astype(float) ** 2).sum(1)).max(initial=0.0)), "segments": segments}


class Block:
    """An index block as arrays."""

    def __init__(self, held: dict):
        self.n, self.width, self.longest = held["n"], held["width"], held["longest"]
        self.ids, self.named = np.frombuffer(held["ids"], "<i8"), np.frombuffer(held["named"], bool)
        self.segments = []
        for s in held["segments"]:
            digits, rest = np.frombuffer(s["digits"], np.int8), np.frombuffer(s["rest"], "<f8")
            if s["rows"] is None:
                self.segments.append((s["step"], None, None, digits.reshape(self.n, self.width), rest))
            else:
                self.segments.append((s["step"], np.frombuffer(s["rows"], "<i4"), np.frombuffer(s["parts"], "<i4"), digits, rest))

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Whole vectors of these rows, from their digits."""
        out, place = np.zeros((len(rows), self.width), np.int64), None
        for step, of, parts, digits, _ in self.segments:
            if of is None:
                out += digits[rows].astype(np.int64) * step
                continue
            if place is None:
                place = np.full(self.n, -1)
                place[rows] = np.arange(len(rows))
            here = place[of] >= 0
            out[place[of[here]], parts[here]] += digits[here].astype(np.int64) * step
        return out

    def add(self, scores: np.ndarray, open_: np.ndarray, queries: np.ndarray, number: int) -> None:
        """Adds a segment to the scores of the open queries."""
        step, rows, parts, digits, _ = self.segments[number]
        if rows is None:
            q = queries[open_]
            exact = float(np.abs(q).max(initial=0)) * 4 * self.width < 2**24  # whole numbers in single precision
            kind = np.float32 if exact else np.float64
            scores[open_] += (q.astype(kind) @ digits.astype(kind).T).astype(float) * step
            return
        ends = np.flatnonzero(np.diff(parts, append=-1)) + 1
        for first, last in zip([0, *ends[:-1]], ends, strict=False):  # the postings of a component
            scores[np.ix_(open_, rows[first:last])] += np.outer(queries[open_, parts[first]], digits[first:last].astype(float) * step)


def best(block: Block, query_ids: list, queries: np.ndarray, least: np.ndarray, k: int, counts: Counter | None = None) -> Iterator[tuple]:
    """(query id, vector id, score) of each query's k best rows of the block
    that reach its `least` score, ties to the smaller id, rows of the query's
    own id left out. `counts` gets what was done."""
    counts = Counter() if counts is None else counts
    n = block.n
    whole = np.zeros((len(queries), block.width), np.int64)  # components that no row has add nothing
    both = min(block.width, queries.shape[1])
    whole[:, :both] = queries[:, :both]
    q = whole.astype(float)
    norms = np.sqrt((q * q).sum(1))
    own = block.named[None, :] & (block.ids[None, :] == np.array(query_ids, np.int64)[:, None])
    scores, open_, last = np.zeros((len(q), n)), np.arange(len(q)), len(block.segments) - 1
    for number, (*_, rest) in enumerate(block.segments):
        block.add(scores, open_, q, number)
        counts["segments"] += len(open_)
        # rounding of sums is far below a part in 2^40
        bound = norms[open_, None] * (rest + 2.0**-40 * block.longest)[None, :] + 1
        lower = np.where(own[open_], -np.inf, scores[open_] - bound)
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        possible = (scores[open_] + bound >= np.maximum(kth, least[open_])[:, None]) & ~own[open_]
        proven = possible.sum(1) <= max(4 * k, POSSIBLE * n)
        counts["stopped"] += int(proven.sum()) if number < last else 0
        for at in np.flatnonzero(proven | (number == last)):
            rows, query = np.flatnonzero(possible[at]), open_[at]
            counts["rescored"] += len(rows)
            full = block.values(rows) @ whole[query]
            order = np.lexsort((block.ids[rows], ~block.named[rows], -full))[:k]
            for j in order[full[order] >= least[query]]:
                yield query_ids[query], int(block.ids[rows[j]]) if block.named[rows[j]] else None, int(full[j])
        open_ = open_[~proven]
        if not len(open_):
            return


def to_integers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id; v, the bytes of floor(scale * x) as 64-bit integers; and their
    norm. Rows without a vector, with a null or non-finite component, or whose
    norm could take scores beyond 64 bits, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, norms = [], []
            for r in b.column(1).to_pylist():
                v = np.floor(scale * np.asarray(r, np.float64))
                norms.append(float(np.sqrt((v * v).sum())))
                rows.append(v.astype("<i8").tobytes() if norms[-1] < MOST_NORM else b"")
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])
            yield made.filter(pa.array([x < MOST_NORM for x in norms], pa.bool_()))

    return vectors.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(run, "vec_id long, v binary, norm double")


def meet(asked: DataFrame, index: DataFrame, blocks: int, slices: int, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each of the index's blocks
    that reach its `least`. asked: vec_id, v, norm, least (or null).

    A task reads a block and then the queries that it may hold rows for as a sorted
    stream. Neither side is broadcast, only the blocks' longest norms; queries of
    one block are dealt over `slices` copies of it.
    """
    reach = F.when((F.col("norm") > 0) & F.col("least").isNotNull(), F.col("least") / F.col("norm")).otherwise(-float("inf"))
    lengths = F.broadcast(index.select("block", "longest"))
    # a query isn't sent to a block none of whose vectors is long enough for it
    sent = asked.withColumn("reach", reach).join(lengths, F.col("longest") * (1 + 1e-9) >= F.col("reach"))
    unit = lambda s: (F.col("block").cast("long") * slices + s).alias("unit")
    sent = sent.select(unit(F.pmod(F.xxhash64("vec_id"), F.lit(slices))), "vec_id", "v", "least")
    held = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(unit(F.col("slice")), *ARROW_INDEX.names)
    rows = held.unionByName(sent, allowMissingColumns=True).repartitionById(min(blocks * slices, MOST_TASKS), F.pmod("unit", F.lit(min(blocks * slices, MOST_TASKS))).cast("int"))

    def scored(block: Block, given: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, values, least = zip(*given, strict=True)
        found = list(best(block, list(ids), matrix(values), np.array([-np.inf if x is None else x for x in least], float), k))
        if found:
            cols = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, given = None, []
        for b in batches:
            asking = list(zip(*(b.column(c).to_pylist() for c in ("vec_id", "v", "least")), strict=True))
            for at, n in enumerate(b.column("n").to_pylist()):
                if given and (n is not None or len(given) == QUERY_ROWS):
                    yield from scored(block, given)
                    given = []
                if n is None:
                    given.append(asking[at])
                else:
                    block = Block(b.slice(at, 1).to_pylist()[0])
        if given:
            yield from scored(block, given)

    return rows.sortWithinPartitions("unit", F.col("n").isNull()).mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of `vectors`.

    Both sides have vec_id and embedding. vec_id names a row: rows of a query's
    own id are no candidates of it, and of several query rows of one id the
    first in order of its bytes asks. Ties go to the smaller vec_id, null ids
    last. Vectors of other lengths count as ending in zeros; those whose norm
    after scaling is 2^31 or more could have scores that 64 bits don't hold, and
    take no part. Empty tables give no rows; a table of fewer rows gives fewer
    results.
    """
    rows = to_integers(vectors, scale)
    blocks = max(1, -(-vectors.count() // INDEX_ROWS))

    def pack(held: pa.Table) -> pa.Table:
        made = build(held["vec_id"].to_pylist(), matrix(held["v"].to_pylist()))
        return pa.Table.from_pylist([{"block": held["block"][0].as_py(), **made}], schema=ARROW_INDEX)

    # by the number of the row, so that one vector in very many rows is dealt evenly too
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    index = common.written(dealt.select("block", "vec_id", "v").groupBy("block").applyInArrow(pack, INDEX), "index")

    groups = max(1, -(-queries.count() // QUERY_ROWS))
    asked = to_integers(queries, scale).filter("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q"))
    asked = common.written(asked.select("vec_id", "q.v", "q.norm"), "asked")
    none = F.lit(None).cast("long").alias("least")
    found = common.written(meet(asked.select("*", none), index.filter("block = 0"), 1, groups, k), "found")
    if blocks > 1:
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        slices = min(groups, -(-common.partitions(vectors.sparkSession) // (blocks - 1)))
        found = found.unionByName(meet(asked.join(floors, "vec_id", "left"), index.filter("block > 0"), blocks - 1, slices, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
