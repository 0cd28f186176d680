"""Near-duplicates: fast similarity sketching, banding, exact verification.

Sketching goes in rounds. In a round every shingle is hashed into one of the
coordinates, and the smallest hash of the first round that reaches a coordinate
stays. After as many rounds as coordinates, each further round fills one given
coordinate, so that all are filled whatever the size of the set; sets over some
hundred shingles fill all in a round or two. Two sets agree in a coordinate
with their Jaccard similarity as probability, concentrated as with independent
hashes.

Rows with equal sets are one class. Classes that agree in all rows of a band
share a bucket. A bucket never lists its pairs: first each class is linked to
the most central class of its bucket, the one with the least share of shingles
of its own; links are confirmed on full sets and joined to components. Only
buckets that still hold several components are looked at again, in blocks of a
bounded number of shingles: pairs across components whose packed sketches leave
the threshold open are counted on full sets, as bits over the shingles that the
block shares. A pair that is linked joins two components and only that leaves
the block, so there are fewer links than rows.

Shingles that no other class of any bucket has bound what a class can share
with any other, and with them the similarity of a pair. This bound is exact. It
rules out most pairs that share a long passage or a common origin, and many
classes as a whole.

A pair at similarity 0.75 misses all 32 bands of 4 rows with probability 5e-6,
a closer one less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.shingles import U, batches, mix, shingle_sets

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
PERCENT = 75
#: Estimates below this can't belong to pairs of 0.75: over five standard deviations.
PLAUSIBLE = 0.55
BLOCK_ROWS, BLOCK_SHINGLES, MOST_BITS = 384, 150_000, 20_000_000
EMPTY = U(0xFFFFFFFFFFFFFFFF)
SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sketches(hashes: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of `size` 64-bit values for each set; rows of empty sets hold EMPTY."""
    n = len(bounds) - 1
    out = np.full(n * size, EMPTY, U)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    h = hashes
    for round_ in range(2 * size):
        if not len(h):
            break
        r = mix(h ^ SEEDS[round_ % len(SEEDS)])
        bin_ = (r >> U(32)).astype(np.int64) % size if round_ < size else np.full(len(r), round_ - size)
        np.minimum.at(out, owner * size + bin_, U(round_) << U(48) | mix(r) >> U(16))
        open_ = (out.reshape(n, size) == EMPTY).any(1)
        if not open_.all():
            rest = open_[owner]
            h, owner = h[rest], owner[rest]
    return out.reshape(n, size)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 (a hash of the set), bands, packed (a byte a coordinate)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for first, texts in batches(b.column(1)):
                h, bounds = shingle_sets(texts)
                n = np.diff(bounds)
                total = [np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(s)), dtype=U))) for s in (0x51, 0xB7E151628AED2A6B)]
                h1, h2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                s = sketches(h, bounds)
                bands = np.zeros((len(texts), BANDS), U)
                for r in range(ROWS):
                    bands = mix(bands * U(31) + s[:, r::ROWS])
                bands = mix(bands + SEEDS[:BANDS]).view(np.int64)
                packed = (mix(s) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), b.column(2).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel())), pa.array([r.tobytes() for r in packed], pa.binary())],
                    ["doc_id", "key", "n", "h1", "h2", "bands", "packed"],
                )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, bands array<long>, packed binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: by id and key a text is found again, also among rows without an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, shingles of the classes, from the text of one document of each."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for first, texts in batches(b.column(3)):
                h, bounds = shingle_sets(texts)
                total = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(0x51)), dtype=U)))
                own = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
                same = own == b.column(1).slice(first, len(texts)).to_numpy()
                sets = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), sets], ["cid", "shingles"])
                yield rows.filter(pa.array(same))

    asked = classes.select("cid", "h1", F.col("one.doc_id").alias("_id"), F.col("one.key").alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    return asked.join(keyed_texts(docs), same).select("cid", "h1", "_id", "text").mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def sharable(sets: DataFrame) -> DataFrame:
    """cid, n, most: the size of a set, and how many of its shingles any other class has."""
    rows = sets.select("cid", F.explode("shingles").alias("s"))
    own = rows.groupBy("s").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("m")).filter("m = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
    n = F.size("shingles").cast("long")
    return sets.select("cid", n.alias("n")).join(own, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))


def possible(n: Column, most: Column, m: Column, most_m: Column) -> Column:
    """Whether two sets of these sizes and sharable parts can reach the threshold."""
    both = F.least(most, most_m)
    return 100 * both >= PERCENT * (n + m - both)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes with an edge, by
    alternating large and small stars until nothing changes. Every round is a
    table in the shared folder; groups are only ever reduced to their minimum."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = common.written(small.distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join different components within buckets. members: key,
    cid, component, n, most, packed. The pairs with a bucket's hub, all those of
    a bucket of two, are known already."""

    def counter(shingles: list[np.ndarray]):
        """(row, rows) -> sizes of the intersections."""
        _, ids, seen = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
        shared = seen > 1
        width = int(shared.sum())
        if width * len(shingles) > MOST_BITS:
            return lambda x, ys: np.array([len(np.intersect1d(shingles[x], shingles[y], assume_unique=True)) for y in ys])
        place = np.cumsum(shared) - 1
        bits = np.zeros((len(shingles), width), bool)
        row = np.repeat(np.arange(len(shingles)), [len(s) for s in shingles])
        bits[row[shared[ids]], place[ids[shared[ids]]]] = True
        packed = np.packbits(bits, axis=1)
        return lambda x, ys: np.bitwise_count(packed[ys] & packed[x]).sum(1, dtype=np.int64)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sketch = np.frombuffer(b"".join(rows["packed"]), np.uint8).reshape(len(rows), SIZE)
        cid, n, most, block = (rows[c].to_numpy() for c in ("cid", "n", "most", "block"))
        _, comp = np.unique(rows["component"].to_numpy(), return_inverse=True)
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        right, common_, found = np.flatnonzero(block == j), None, []
        for x in np.flatnonzero(block == i):
            both = np.minimum(most[right], most[x])
            ys = right[(comp[right] != comp[x]) & (100 * both >= PERCENT * (n[right] + n[x] - both))]
            if i == j:
                ys = ys[ys > x]
            if len(ys):
                ys = ys[((sketch[ys] == sketch[x]).mean(1) - 1 / 256) / (1 - 1 / 256) >= PLAUSIBLE]
            if len(ys):
                common_ = common_ or counter([np.asarray(s) for s in rows["shingles"]])
                both = common_(x, ys)
                for y in ys[100 * both >= PERCENT * (n[ys] + n[x] - both)]:
                    if comp[y] != comp[x]:
                        found.append((cid[x], cid[y]))
                        comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # blocks of the largest component of a bucket meet those of the others only: within it all are linked
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sized = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum("t").alias("total"), F.count(F.lit(1)).alias("spread"), F.max(F.struct("c", "t", "component")).alias("top")).filter("spread > 1 and m > 2")
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")
    sized = sized.select("key", F.col("top.component").alias("largest"), blocks(F.col("top.c"), F.col("top.t")).alias("p"), blocks(F.col("m") - F.col("top.c"), F.col("total") - F.col("top.t")).alias("q"))
    rows = members.join(sized, "key").withColumn("main", F.col("component") == F.col("largest"))
    dealt = F.xxhash64("cid")
    rows = rows.withColumn("block", F.when(F.col("main"), F.pmod(dealt, F.col("p"))).otherwise(F.col("p") + F.pmod(dealt, F.col("q"))).cast("int"))
    met = F.sequence(F.when(F.col("main"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    rows = rows.join(sets, "cid").withColumn("other", F.explode(met))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    component_id is the smallest doc_id of the rows reachable over links; a row
    without words has no links. A null doc_id is never the smallest; a component
    of null ids only has a null component_id, and its rows are kept. Repeated
    rows are in one component; an empty table gives no rows. Other columns are
    not read.
    """
    return near_duplicate_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """As near_duplicates, with key (xxhash64 of the text) and stays: whether a
    row is the representative of its component.

    The representative is the row of the smallest doc_id, rows without an id
    last, and of the smallest key among several rows of that id. Rows without
    words are their own. Rows of one doc_id and one text stay together.
    """
    rows = common.written(sketch_documents(docs), "sketches")
    same = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    classes = common.written(same.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("cid", F.posexplode("bands").alias("band", "hash")).select("cid", F.xxhash64("band", "hash").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = common.written(keyed.join(shared.select("key"), "key"), "buckets")
    sets = common.written(full_sets(docs, classes.join(met.select("cid").distinct(), "cid")), "sets")
    # classes that may have a link at all, the most central one of each bucket in its middle
    able = common.written(sharable(sets).filter(100 * F.col("most") >= PERCENT * F.col("n")), "able")
    members = common.written(met.join(able, "cid"), "members")
    hub = F.min(F.struct((1 - F.col("most") / F.col("n")).alias("own"), "cid", "n", "most")).alias("hub")
    met_hub = members.join(members.groupBy("key").agg(hub), "key").filter(F.col("cid") != F.col("hub.cid"))
    stars = met_hub.filter(possible(F.col("n"), F.col("most"), F.col("hub.n"), F.col("hub.most"))).select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct()
    links = common.written(confirmed(stars, sets), "links")
    labels = components(links)

    named = members.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    new = common.written(links_across(named.join(classes.select("cid", "packed"), "cid"), sets), "links")
    if not new.isEmpty():
        labels = components(links.unionByName(new))

    named = classes.select("h1", "h2", "cid", "one").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("one").alias("first"))
    of_set = named.join(least, "component").select("h1", "h2", "first")
    out = rows.select("doc_id", "key", "n", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    linked = (F.col("n") > 0) & F.col("first").isNotNull()
    component = F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stays = ~linked | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("key").eqNullSafe(F.col("first.key")))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), stays.alias("stays"))
