"""Conversation structure repair: Dijkstra on the lattice of turns and grammar states.

A conversation's role initials have to read `(s?(ua)+)?`. A node of the lattice is
(rows consumed, state of that grammar); edges keep, re-role or delete the next
row, or insert an empty one. Nodes are popped by (cost, audit), the audit being
the initials of the edits so far, and the first accepting end node popped has the
cheapest repair, of equally cheap ones the least audit.

The lattice needs a code of a few bits for a row, never its text. Long
conversations are cut into blocks of BLOCK rows, which are solved apart from each
state they may start in, in different tasks; the same search then runs over
(blocks consumed, state). Two ways between the same two nodes have equal costs
only if neither audit begins with the other, so the best whole is made of best
parts. Texts follow in order of their rows, a batch at a time: no task holds a
conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 512
#: Costs of edits; TRUNCATED is added to a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. NEXT gives the state after a role, if it may follow.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Codes of rows: the place of the initial here, plus 4 if truncated, plus 8 if it has to go.
INITIALS = "sua?"
COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")


def ends(codes: bytes, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) of the end nodes of the lattice, in the order in which they are popped."""
    heap, done = [(0, "", 0, state)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(codes):
            yield cost, audit, state
        else:
            code = codes[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if code < 8:
                initial, stays = INITIALS[code & 3], TRUNCATED * (code >> 2)
                for role, to in NEXT[state].items():
                    if role == initial:
                        heapq.heappush(heap, (cost + stays, audit + "K", at + 1, to))
                    elif role in ROLES:
                        heapq.heappush(heap, (cost + stays + REROLE, audit + "R", at + 1, to))
        for role, to in NEXT[state].items():
            if role in ROLES:
                heapq.heappush(heap, (cost + INSERT, audit + "I", at, to))


def joined(blocks: list[dict[int, list[tuple[int, str, int]]]]) -> tuple[int, str]:
    """Cost and audit of the best way through blocks: for each state it starts in, the ends of a block."""
    heap, done = [(0, "", 0, 0)], set()
    while True:  # deleting everything always ends in state 0
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(blocks) and state in ACCEPTING:
            return cost, audit
        if at < len(blocks) and (at, state) not in done:
            done.add((at, state))
            for more, edits, to in blocks[at].get(state, ()):
                heapq.heappush(heap, (cost + more, audit + edits, at + 1, to))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos, code, and the counts of a row, for rows of
    conv_id, turn, role, text, gone. Rows that are gone have no pos and come first;
    equal turns go by role and text. A conversation's order is known to one task,
    which sorts it on disk where memory doesn't do."""
    kept = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumn("_last", F.right(kept, F.lit(1)))
    # repeats are found by their own key, so a conversation is spread over tasks here
    same = Window.partitionBy("conv_id", "gone", "_hash", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("_hash", F.xxhash64("role", "text")).withColumn("_again", F.row_number().over(same) > 1).drop("_hash")
    by = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    initial, flag = F.left("role", F.lit(1)), lambda c: F.coalesce(c, F.lit(False)).cast("int")
    before = lambda c: F.when(~F.col("gone"), F.lag(c).over(by))
    rows = rows.withColumn("pos", F.row_number().over(by) - 1).withColumn("_before", before(initial)).withColumn("_turn", before(F.col("turn")))
    fault = F.when(F.col("_last") == "", "blank").when(F.col("_again"), "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("_fault", fault)
    is_ = lambda name: F.coalesce(F.col("_fault") == name, F.lit(False))
    place = F.position(initial, F.lit(INITIALS[:3]))
    code = F.when((place == 0) | (initial == ""), F.lit(3)).otherwise(place - 1)
    code = code + 4 * is_("truncated").cast("int") + 8 * (is_("blank") | is_("duplicate")).cast("int")
    pair = F.concat("_before", initial)
    return rows.select(
        "conv_id", "turn", "role", "text", "gone", "pos", code.cast("int").alias("code"),
        flag(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("turns"),
        *(is_(n).cast("int").alias(n) for n in COUNTS[1:4]),
        flag(~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def streamed(found: Iterable[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches, by their first `by` values, without holding a group."""
    rows = (r for b in found for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:by])


class Told:
    """Rows as batches of a bounded number of rows and characters."""

    def __init__(self, schema: pa.Schema, rows: int = 8192, chars: int = 4_000_000):
        self.schema, self.rows, self.chars, self.held, self.size = schema, rows, chars, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += size
        if len(self.held) >= self.rows or self.size >= self.chars:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.held), self.schema.types)], schema=self.schema)
        self.held, self.size = [], 0


ARC = pa.struct([("start", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("end", pa.int32())])
PARTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("arcs", pa.list_(ARC))])
REPORT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((n, pa.int64()) for n in COUNTS[1:]), ("cost", pa.int64()), ("audit", pa.string())])
DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<struct<start:int,cost:long,audit:string,end:int>>' if f.name == 'arcs' else DDL[f.type]}" for f in schema)


def least(values: Iterable[int | None]) -> int | None:
    return min((v for v in values if v is not None), default=None)


def reports(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for coded rows."""

    def solve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Told(PARTS, 1024)
        for (conv, block), own in streamed(found, 2):
            codes, sums, low, high = bytearray(), [0] * len(COUNTS), None, None
            for _, _, _, gone, turn, code, *counts in own:
                if not gone:
                    codes.append(code)
                    low, high = least((low, turn)), turn if high is None else high if turn is None else max(high, turn)
                    sums = [a + b for a, b in zip(sums, counts)]
            arcs = [{"start": s, "cost": c, "audit": a, "end": e} for s in (range(len(NEXT)) if block else (0,)) for c, a, e in ends(bytes(codes), s)]
            yield from out.add((conv, block, low, high, *sums, arcs))
        yield from out.rest()

    def report(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Told(REPORT)
        for (conv,), own in streamed(found, 1):
            blocks, sums, low, high = [], [0] * len(COUNTS), None, None
            for _, _, lo, hi, *counts, arcs in own:
                low, high = least((low, lo)), hi if high is None else high if hi is None else max(high, hi)
                sums = [a + b for a, b in zip(sums, counts)]
                by_start: dict[int, list] = {}
                for arc in arcs:
                    by_start.setdefault(arc["start"], []).append((arc["cost"], arc["audit"], arc["end"]))
                blocks.append(by_start)
            cost, audit = joined(blocks)
            gaps = 0 if low is None else high - low + 1 - sums[0]
            yield from out.add((conv, gaps, *sums[1:], cost, audit), len(audit))
        yield from out.rest()

    block = F.floor(F.col("pos") / BLOCK)
    parts = rows.select("conv_id", block.alias("block"), "pos", "gone", "turn", "code", *COUNTS).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(solve, ddl(PARTS))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(report, ddl(REPORT))


REPAIRED = pa.schema([*REPORT, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The role and text of rows after the edits of their audit."""
    state = 0
    for edit in audit:
        if edit == "I":
            state = 3 if state == 2 else 2
            yield ROLES["a" if state == 3 else "u"], ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        state = NEXT[state][role[0]] if edit == "K" else 3 if state == 2 else 2
        yield role if edit == "K" else ROLES["a" if state == 3 else "u"], text


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of repaired conversations in order within their partitions: place
    (from 0), role, text. Before them each conversation has a row with its report and no place."""
    names = [f.name for f in REPORT]

    def apply(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Told(REPAIRED)
        for (conv,), own in streamed(found, 1):
            _, _, _, _, *told = next(own)
            yield from out.add((conv, *told, None, None, None))
            for place, (role, text) in enumerate(edited(told[-1], ((r[2], r[3]) for r in own))):
                yield from out.add((conv, *[None] * len(told), place, role, text), len(text))
        yield from out.rest()

    text = lambda c: c.cast("string")
    of_rows = rows.filter(~F.col("gone")).select("conv_id", F.col("pos").cast("long"), "role", "text", *(F.lit(None).cast("string" if n == "audit" else "long").alias(n) for n in names[1:]))
    heads = report.select("conv_id", F.lit(-1).cast("long").alias("pos"), text(F.lit(None)).alias("role"), text(F.lit(None)).alias("text"), *names[1:])
    return heads.unionByName(of_rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(apply, ddl(REPAIRED))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Repairs conversations: see `repaired`.

    rows: conv_id, turn, role, text and gone, true for rows that only say that
    there is such a conversation. A null conv_id is a conversation of its own;
    null roles and texts count as one space, null turns come first; rows of equal
    turns go by role and text, and repeated rows are duplicates. Empty roles have
    no initial. Other columns are not read, an empty table gives no rows.
    """
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce("gone", F.lit(False)).alias("gone"))
    table = common.written(coded(given), "turns")
    return repaired(table, reports(table))


def digested(rows: DataFrame) -> DataFrame:
    """Each report with repaired_sha256: of `role:text` of the repaired rows, joined by newlines."""
    schema = pa.schema([*REPORT, ("repaired_sha256", pa.string())])

    def digest(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Told(schema)
        for (_,), own in streamed(found, 1):
            head, sha = next(own)[: len(REPORT)], hashlib.sha256()
            for *_, place, role, text in own:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield from out.add((*head, sha.hexdigest()), len(head[-1]))
        yield from out.rest()

    return rows.mapInArrow(digest, ddl(schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows dropped (gone), emptied, without ends of sentences, repeated or given to the user, by the checksum of conv_id:turn."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).when(F.col("_kind") != 0, F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")
