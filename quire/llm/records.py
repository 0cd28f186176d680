"""Token ids as length-delimited binary records with a separate offset index.

A shard holds records in ascending doc_id order. A record is

    length (u64) | masked crc32 of the length (u32) | payload | masked crc32 of the payload (u32)

and a payload is: flags (u8: 1 doc_id present, 2 ids are 32 bits wide), doc_id
(i64), ids. The index beside a shard holds the offset of every record (u64), so
records can be read in any order. All numbers are little-endian. Files lie in a
folder that all executors share and are reached through pyarrow's file systems.

A task that runs twice writes files of different names; the manifest, a table
committed by Spark, names the files of the attempt that counted.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common
from quire.llm.bpe import encoder

HEAD, LENGTH = struct.Struct("<Bq"), struct.Struct("<Q")
HAS_ID, WIDE = 1, 2
#: Bytes of records read at once, about.
SPAN = 4_000_000
MANIFEST = "shard int, path string, records long, tokens long"


class Corrupt(ValueError):
    """A record whose checksum doesn't match."""


def masked(data: bytes) -> int:
    """crc32, rotated and shifted so that a checksum of checksums stays apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(f) -> bytes | None:
    """The next payload of a file; None at its end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise Corrupt("record length")
    rest = f.read(LENGTH.unpack(head[:8])[0] + 4)
    payload = bytes(rest[:-4])
    if len(payload) + 4 != LENGTH.unpack(head[:8])[0] + 4 or masked(payload) != struct.unpack("<I", rest[-4:])[0]:
        raise Corrupt("record payload")
    return payload


def pack(doc_id: int | None, ids: bytes) -> bytes:
    numbers = np.frombuffer(ids, "<u4")
    wide = bool(len(numbers)) and int(numbers.max()) > 0xFFFF
    return HEAD.pack((HAS_ID if doc_id is not None else 0) | (WIDE if wide else 0), doc_id or 0) + (ids if wide else numbers.astype("<u2").tobytes())


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=HEAD.size).astype("<u4")
    return doc_id if flags & HAS_ID else None, ids


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes every text, appends end_id, writes shards under `folder`; returns
    the manifest: shard, path, records, tokens.

    A null text counts as empty: its record holds end_id alone. A null doc_id
    sorts first; equal ids sort by text. Texts are dealt by ranges of doc_id, so
    shard k holds smaller ids than shard k + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        offsets, at, tokens, out = [], 0, 0, None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{path}.rec")
                ids = enc.encode(text) + end
                record = frame(pack(doc_id, ids))
                out.write(record)
                offsets.append(at)
                at, tokens = at + len(record), tokens + len(ids) // 4
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}.idx") as f:
                f.write(np.asarray(offsets, "<u8").tobytes())
            name = f"{folder}/{path[len(root) + 1 :]}"
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "records": [len(offsets)], "tokens": [tokens]})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(common.partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.written(dealt.mapInArrow(run, MANIFEST), "record-manifest")


def read_spans(path: str, records: int, tokens: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The records of a shard, some MB at a time, at the places that its offset
    index names. Numbers of records and tokens have to be those of the manifest,
    and records have to follow each other up to the end of the file."""
    store, place = fs.FileSystem.from_uri(f"{path}.idx")
    with store.open_input_stream(place) as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    place = place[:-4] + ".rec"
    ends = np.append(offsets[1:], store.get_file_info(place).size)
    if len(offsets) != records or (len(offsets) and offsets[0] != 0) or (ends <= offsets).any():
        raise Corrupt("offset index")
    seen = 0
    with store.open_input_file(place) as f:
        first = 0
        while first < records:
            last = max(first + 1, int(np.searchsorted(ends, offsets[first] + SPAN, side="right")))
            f.seek(int(offsets[first]))
            data = io.BytesIO(f.read(int(ends[last - 1] - offsets[first])))
            found = []
            for n in range(first, last):
                payload = unframe(data)
                if payload is None or data.tell() != ends[n] - offsets[first]:
                    raise Corrupt("record length")
                found.append(unpack(payload))
                seen += len(found[-1][1])
            yield found
            first = last
    if seen != tokens:
        raise Corrupt("number of tokens")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary,
    little-endian unsigned 32-bit), from the shards through their offset
    indexes; checksums and the manifest's counts are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.to_pylist():
                start = shard["start"]
                for found in read_spans(shard["path"], shard["records"], shard["tokens"]):
                    sizes = np.array([len(ids) for _, ids in found])
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    columns = [pa.array([d for d, _ in found], pa.int64()), pa.array(starts, pa.int64()), pa.array([ids.tobytes() for _, ids in found], pa.large_binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    started = manifest.select("path", "records", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    return started.repartition(common.partitions(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, ids binary")


def read_some(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of a shard with these numbers, through its offset index, in the order asked for."""
    store, place = fs.FileSystem.from_uri(f"{path}.idx")
    with store.open_input_stream(place) as f:
        offsets = np.frombuffer(f.read(), "<u8")
    found = []
    with store.open_input_file(place[:-4] + ".rec") as f:
        for n in numbers:
            f.seek(int(offsets[n]))
            found.append(unpack(unframe(f)))
    return found
