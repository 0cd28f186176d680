"""Spelling variants: words one edit apart, found by letter-parity bitmasks.

A word's mask has a bit for each letter: whether the letter occurs an odd number
of times. One inserted or deleted letter flips one bit, a replaced one flips two.
The mask is split into three bands. A replacement leaves at least one band as it
was, so words of one length meet by each of their bands; an insertion leaves two,
so words of neighbouring lengths meet by each two of their bands. Length and
bands are the key of the join.

Masks say little about words built of the same syllables, and buckets grow with
the vocabulary. So no bucket lists its pairs: within it, rows are sorted by
hashes of the word without one of its letters, at a place that two words of one
length share, and neighbours with equal hashes are verified letter by letter. A
bucket of very many letters is dealt by the same hashes into parts of bounded
size; a word is in as many parts of it as it has letters, at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.shingles import BASE, LOWER, U, mix

SHORTEST, LEAST, CLEAR, DAMAGE = 7, 2, 10, 31
#: Letters by frequency, so that each band gets as many frequent ones as the others; then all others.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
PLACE = np.zeros(0x100, np.int64)
PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
CODES, BACK = mix(np.arange(1, len(LETTERS) + 1, dtype=U) * BASE), U(pow(int(BASE), -1, 1 << 64))
#: Letters of a part of a bucket, about, and rows that a task compares at once.
PART, AT_ONCE = 500_000, 50_000
#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000


def damaged(doc_id: str, run: str) -> str:
    """The run, without one code point if its checksum says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that occur often enough. A null doc_id is
    the empty string in checksums; rows of one doc_id count as often as they are there."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in found:
            for doc, text in zip(b.column(0), b.column(1)):
                own = Counter(runs.findall((text.as_py() or "").encode().translate(LOWER).decode()))
                id_ = doc.as_py() or ""
                for run, n in own.items():
                    word = damaged(id_, run)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) > HELD:
                    yield told()
        if held:
            yield told()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def masked(words: DataFrame) -> DataFrame:
    """word, n, length, and the bands b0, b1, b2 of its mask."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            own = b.column(0).to_pylist()
            length = np.array([len(w) for w in own], np.int64)
            place = PLACE[np.frombuffer("".join(own).encode("utf-32-le"), "<u4")]
            starts = np.cumsum(length) - length
            bands = [np.bitwise_xor.reduceat(np.where(place % 3 == k, 1 << place // 3, 0), starts).astype(np.int32) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (length.astype(np.int32), *bands))], ["word", "n", "length", "b0", "b1", "b2"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, b0 int, b1 int, b2 int")


def buckets(masks: DataFrame) -> DataFrame:
    """The rows of masks by kind and key of the buckets they are in, and parts of those.

    Kinds 0 to 2: one length and band `kind` equal. Kinds 3 to 5: lengths l and
    l + 1, of which the row has the longer or not, and all bands but `kind - 3` equal.
    """
    bands = ["b0", "b1", "b2"]
    at = lambda kind, longer, *of: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), F.col("length") - longer, *of).alias("key"), F.lit(bool(longer)).alias("longer"))
    same = [at(k, 0, b) for k, b in enumerate(bands)]
    next_ = [at(3 + k, longer, *(b for b in bands if b != bands[k])) for k in range(3) for longer in (0, 1)]
    rows = masks.withColumn("_at", F.explode(F.array(*same, *next_))).select("_at.*", "word", "n")
    parts = F.ceil(F.col("m") / PART).cast("int")
    large = rows.groupBy("kind", "key").agg(F.sum(F.length("word").cast("long")).alias("m")).select("kind", "key", parts.alias("parts")).filter("parts > 1")
    return rows.join(large, ["kind", "key"], "left").select(*rows.columns, F.coalesce("parts", F.lit(1)).alias("parts")).mapInArrow(dealt, "kind int, key long, longer boolean, word string, n long, parts int, part int")


def entries(kind: np.ndarray, longer: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, letter, hash: of each row, the hashes of its word less one letter, for
    each place of one; of two lengths, the longer has one for each run of equal
    letters, and the shorter that of its whole word, with letter -1."""
    length = np.array([len(w) for w in words], np.int64)
    place = PLACE[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
    row = np.repeat(np.arange(len(words)), length)
    starts = np.cumsum(length) - length
    at = np.arange(len(row)) - starts[row]
    part = CODES[place] * powers(int(length.max(initial=0)))[at]
    sums = np.concatenate((np.zeros(1, U), np.cumsum(part, dtype=U)))
    before, whole = sums[:-1] - sums[starts][row], sums[starts + length] - sums[starts]
    less = before + (whole[row] - before - part) * BACK
    two = (kind >= 3)[row]
    new = at == 0
    new[1:] |= place[1:] != place[:-1]
    told = np.where(two, longer[row] & new, True)
    hashed = mix(np.where(two, less, less ^ mix(at.astype(U))))
    short = np.flatnonzero((kind >= 3) & ~longer)
    return np.concatenate((short, row[told])), np.concatenate((np.full(len(short), -1), place[told])), np.concatenate((mix(whole[short]), hashed[told]))


def powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, U), np.cumprod(np.full(n, BASE, U))))


def part_of(hashed: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (hashed % parts.astype(U)).astype(np.int32)


def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part; rows of buckets in several parts are in all parts of their entries."""
    for b in found:
        parts = b.column(5).to_numpy()
        one = b.filter(pa.array(parts == 1))
        yield pa.RecordBatch.from_arrays([*one.columns, pa.array(np.zeros(one.num_rows, np.int32))], [*b.schema.names, "part"])
        if (parts > 1).any():
            more = b.filter(pa.array(parts > 1))
            row, _, hashed = entries(more.column(0).to_numpy(), more.column(2).to_numpy(zero_copy_only=False), more.column(3).to_pylist())
            in_ = np.unique(row << 32 | part_of(hashed, more.column(5).to_numpy()[row]))
            out = more.take(pa.array(in_ >> 32))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array((in_ & 0xFFFFFFFF).astype(np.int32))], [*b.schema.names, "part"])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one edit makes b, of the same length or one less, from a."""
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and a[at + 1 :] == b[at + 1 if len(a) == len(b) else at :]


def candidates(kind: np.ndarray, bucket: np.ndarray, row: np.ndarray, letter: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, the longer first, with equal hashes in one bucket, each in one of its buckets."""
    order = np.lexsort((letter, hashed, bucket[row]))
    row, letter, hashed = row[order], letter[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (bucket[row[1:]] != bucket[row[:-1]]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(row)))
    top, left = np.repeat(at, size), np.repeat(at + size, size) - np.arange(len(row)) - 1
    longer = np.flatnonzero((letter >= 0) & (letter[top] < 0))
    yield row[longer], row[top[longer]]
    # of one length: a run holds a word for each letter in the open place, at most
    s = np.flatnonzero(kind[row] < 3)
    for step in range(1, int(left[s].max(initial=0)) + 1):
        s = s[left[s] >= step]
        a, b = letter[s] % 3, letter[s + step] % 3
        # two bands are equal if both letters are of one: the first of them tells the pair
        told = kind[row[s]] == np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
        yield row[s[told]], row[s[told] + step]


def near_words(masks: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of words one edit apart."""
    by = ["kind", "key", "parts", "part"]

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in [*by, "longer", "n"]}
        own = rows.column("word").to_pylist()
        word = pa.array(own, pa.string())
        bucket = np.cumsum(np.concatenate(([0], np.any([c[k][1:] != c[k][:-1] for k in by], axis=0))))
        row, letter, hashed = entries(c["kind"], c["longer"], own)
        here = part_of(hashed, c["parts"][row]) == c["part"][row]
        for x, y in candidates(c["kind"], bucket, row[here], letter[here], hashed[here]):
            told = np.array([one_edit(own[a], own[b]) for a, b in zip(x, y)], bool)
            if told.any():
                both, other = np.concatenate((x[told], y[told])), np.concatenate((y[told], x[told]))
                yield pa.RecordBatch.from_arrays([word.take(pa.array(both)), pa.array(c["n"][both]), word.take(pa.array(other)), pa.array(c["n"][other])], ["word", "n", "near", "near_n"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in found:
            held.append(b)
            if sum(x.num_rows for x in held) < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(k).to_numpy() for k in by]
            before = np.flatnonzero(np.any([v != v[-1] for v in last], axis=0))
            whole = int(before[-1]) + 1 if len(before) else 0  # the last bucket may go on in the next batch
            if whole:
                yield from compared(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    dealt_out = buckets(masks).repartition("kind", "key", "part").sortWithinPartitions("kind", "key", "part")
    return dealt_out.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: where `steps` steps along the forms (word, form) lead, the chain's end if it is nearer."""
    forms = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        further = forms.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        forms = common.written(forms.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
        done *= 2
    return forms


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of `docs` with the word it is a variant of.

    Null and empty texts have no words; an empty table gives no rows. Ties in n
    go to the smallest word in code-point order. Columns besides doc_id and text
    are not read. A form has CLEAR times the occurrences of its word, so a chain
    is no longer than the logarithm of the largest number of occurrences.
    """
    counted = common.written(masked(words(docs)), "words")
    links = near_words(counted)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    clear = -F.col("best.less") >= CLEAR * F.col("n")
    rows = counted.select("word", "n").join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("best.near")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n"))
    rows = common.written(rows, "forms")
    most, steps = rows.agg(F.max("n")).first()[0] or 0, 0
    while LEAST * CLEAR ** (steps + 1) <= most:
        steps += 1
    named = roots(rows.filter("form IS NOT NULL"), steps)
    return rows.join(named, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
