"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text sets chunk ends where the last 16 bytes
say so, hence a passage that many documents share falls into the same chunks
wherever it stands. A worker encodes a chunk once, as if it were a text, and
keeps its ids by parts: runs of other characters with the white space before
them, between which no token goes. A chunk end may stand inside a part, or
inside white space, where the ids of both sides are wrong. So each join is
repaired: a window over the last part before it and the first part after it is
encoded anew, with a further part on either side, and if those two come out
with the ids that the chunks have for them, the window's ids replace those of
the chunks; if not, the window grows by as many parts again, over further
chunks if need be, until both sides agree or the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.bpe import ODD, ODD_SPLIT, PART, Encoder, Memory, encoder

WINDOW, MEAN, LEAST = 16, 256, 32
#: Chunks held at once by a worker, about 1 KB each; the memory is then emptied.
MOST_CHUNKS = 60_000
#: Longer chunks, as texts without any variety give, aren't held.
LONGEST_CHUNK = 4096
ROWS = 500


def chunk_ends(data: bytes) -> list[int]:
    """Ends of chunks, the last being len(data); a function of the bytes near each end."""
    h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    width, factor = 1, 0x9E3779B1
    while width < WINDOW and len(h) > width:  # the hash of twice as many bytes from two hashes
        shifted = h[:-width] * np.uint32(factor)
        h = h.copy()
        h[width:] += shifted
        width, factor = 2 * width, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    ends, last = [], 0
    for e in (np.flatnonzero(h & np.uint32(MEAN - 1) == 0) + 1).tolist():
        while e < len(data) and data[e] & 0xC0 == 0x80:  # not inside a character
            e += 1
        if e - last >= LEAST:
            ends.append(e)
            last = e
    if last < len(data):
        ends.append(len(data))
    return ends


class ChunkEncoder:
    def __init__(self, inner: Encoder):
        self.inner, self.memory = inner, {}
        #: ids of parts, which chunks and windows share
        self.parts = Memory(inner.encode)
        #: how often a window was encoded, and how often it had to grow
        self.windows = self.grown = 0

    def chunk(self, data: bytes) -> tuple[list[str], list[bytes]]:
        """The parts of a chunk, and the ids of each."""
        found = self.memory.get(data)
        if found is None:
            parts = PART.findall(data.decode())
            found = parts, list(map(self.parts.__getitem__, parts))
            if len(self.memory) >= MOST_CHUNKS:
                self.memory.clear()
            if len(data) <= LONGEST_CHUNK:
                self.memory[data] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if (ODD_SPLIT if self.inner.ends else ODD).search(text):
            # white space of other kinds joins in runs that parts don't show; those texts take the encoder's own cuts
            return self.inner.encode(text)
        data, last = text.encode(), 0
        parts: list[str] = []
        ids: list[bytes] = []
        for end in chunk_ends(data):
            more, more_ids = self.chunk(data[last:end])
            last = end
            parts, ids = self.joined(parts, ids, more, more_ids) if parts else (list(more), list(more_ids))
        return b"".join(ids)

    def joined(self, parts: list[str], ids: list[bytes], more: list[str], more_ids: list[bytes]) -> tuple[list[str], list[bytes]]:
        """The parts and ids of a text so far and of the next chunk, the join between them repaired."""
        reach = 1
        while True:
            # the join takes `reach` parts of either side, and a witness beyond if there is one
            left, right = min(reach + 1, len(parts)), min(reach + 1, len(more))
            window = PART.findall("".join(parts[-left:]) + "".join(more[:right]))
            made = list(map(self.parts.__getitem__, window))
            self.windows += 1
            first_agrees = left == len(parts) or (made[0] == ids[-left] and window[0] == parts[-left])
            last_agrees = right == len(more) or (made[-1] == more_ids[right - 1] and window[-1] == more[right - 1])
            if first_agrees and last_agrees:
                del parts[-left:], ids[-left:]
                parts += window
                ids += made
                parts += more[right:]
                ids += more_ids[right:]
                return parts, ids
            reach, self.grown = 2 * reach, self.grown + 1


class Decoder:
    """Ids to text, as ``Tokenizer.decode(ids, skip_special_tokens=False)``."""

    def __init__(self, inner: Encoder):
        self.tokenizer = inner.tokenizer
        self.table = None
        if self.tokenizer.decoder is None:  # tokens with a space between
            self.table = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.table is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        return " ".join([t for t in map(self.table.__getitem__, numbers) if t is not None])


_MADE: dict[str, tuple[ChunkEncoder, Decoder]] = {}


def codec(path: str) -> tuple[ChunkEncoder, Decoder]:
    if path not in _MADE:
        inner = encoder(path)
        _MADE[path] = ChunkEncoder(inner), Decoder(inner)
    return _MADE[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (the text of
    the ids), one row a row of `docs`.

    A null text counts as empty: no ids and an empty text. Equal rows give
    equal rows; other columns of `docs` are not read. No shuffle: every row is
    encoded where it was read, and a very long text costs memory of its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = codec(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = [enc.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.large_binary()), pa.array([dec.decode(i) for i in ids], pa.large_string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, ids binary, decoded string")
