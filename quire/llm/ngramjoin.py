"""N-gram Jaccard join: blocks of shingle sets joined through prefix trees.

Rows with equal sets are one class. Classes meet by the first PREFIX shingles of
their sets in order of hashes: of the first 32 shingles of the union of two sets
at 0.80, all are in one set only with probability 0.2^32, fewer than 8 in both
with 3e-12, and sets of 40 shingles or fewer always have as many. So a class of
which fewer than a quarter of these shingles are known to others has no links,
and neither has one too few of whose shingles any other class has.

The sets of a bucket are ordered by frequency, rarest shingle first, and stored
in a trie with its single paths run together. All sets walk it at once: overlaps
are counted once for a path that sets share, and a set leaves a subtree when what
is left of it, or of the longest set below, can't make the overlap that the
smallest set below asks for.

In a first round each class is joined in the buckets of its first two shared
shingles, in blocks of bounded size, each with the most central class of its
bucket. Then only buckets that hold several components are joined again, in
pairs of blocks; blocks of the largest component don't meet each other. A link
within a component isn't told, so there are fewer links than rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common, neardup
from quire.llm.shingles import U, batches, mix, shingle_sets

PERCENT, PREFIX = 80, 32
BLOCK_ROWS, BLOCK_SHINGLES = 384, 150_000


def prefixed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, h1, h2 (hashes of the set), prefix (its least hashes) of every row."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for first, texts in batches(b.column(1)):
                h, bounds = shingle_sets(texts)
                n = np.diff(bounds)
                total = [np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(s)), dtype=U))) for s in (0x51, 0xB7E151628AED2A6B)]
                h1, h2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                short = np.minimum(n, PREFIX)
                ends = np.concatenate(([0], np.cumsum(short)))
                at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], short)  # sets are sorted by hash
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(2).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), prefix], ["doc_id", "key", "n", "h1", "h2", "prefix"])

    return neardup.keyed_texts(docs).mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, prefix array<long>")


def trie_links(sets: list[np.ndarray], n: np.ndarray, component: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (numbers of sets) that join different components.

    sets: distinct hashes; n: sizes of the whole sets (hashes nobody else has may
    be left out). Where sides are given, only sets of different sides are linked.
    """
    m, comp, found = len(sets), component.copy(), []
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    order = np.flatnonzero(shared)[np.lexsort((values[shared], seen[shared]))]  # rarest first
    rank = np.full(len(values), -1)
    rank[order] = np.arange(len(order))
    row, id_, width = row[shared[at]], rank[at[shared[at]]], len(order)
    keys = np.sort(row * width + id_)
    size = np.bincount(row, minlength=m)
    start = np.cumsum(size) - size
    held = np.zeros((m, width), bool)
    held[row, id_] = True
    sequences = [keys[start[r] : start[r] + size[r]] - r * width for r in range(m)]
    path = sorted(range(m), key=lambda r: sequences[r].astype(">u4").tobytes())
    lcp = np.zeros(m + 1, np.int64)  # of a set and the one before it in the trie
    for k in range(1, m):
        a, b = sequences[path[k - 1]], sequences[path[k]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        lcp[k] = differ[0] if len(differ) else short
    path = np.array(path)
    stack = [(0, m, 0, np.arange(m), np.zeros(m, np.int64))]  # sets below, depth, sets that walk (by place in path), their overlaps
    while stack:
        lo, hi, depth, walk, both = stack.pop()
        below = path[lo:hi]
        end = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(size[below[0]])
        # each pair is met once: by the later of its sets in the path; components told by now don't meet
        go = walk > lo
        of = np.unique(comp[below])
        if len(of) == 1:
            go &= comp[path[walk]] != of[0]
        walk, both = walk[go], both[go]
        if not len(walk):
            continue
        x = path[walk]
        left = size[x]
        if end > depth:
            run = sequences[below[0]][depth:end]
            both = both + held[np.ix_(x, run)].sum(1)
        if end:
            passed = np.searchsorted(keys, x * width + sequences[below[0]][end - 1], side="right") - start[x]
            left = size[x] - passed
        least, most = n[below].min(), n[below].max()
        top = both + np.minimum(left, size[below].max() - end)
        fits = (100 + PERCENT) * top >= PERCENT * (n[x] + least)
        fits &= (100 * n[x] >= PERCENT * least) & (PERCENT * n[x] <= 100 * most)
        walk, both, x = walk[fits], both[fits], x[fits]
        if not len(walk):
            continue
        k = lo
        while k < hi and size[path[k]] == end:  # sets that end here
            y = path[k]
            linked = (walk > k) & ((100 + PERCENT) * both >= PERCENT * (n[x] + n[y])) & (comp[x] != comp[y])
            if side is not None:
                linked &= side[x] != side[y]
            for z in x[linked]:
                if comp[z] != comp[y]:
                    found.append((int(y), int(z)))
                    comp[comp == comp[z]] = comp[y]
            k += 1
        cuts = [k, *(c for c in (np.flatnonzero(lcp[k + 1 : hi] == end) + k + 1).tolist()), hi]
        stack.extend((a, b, end, walk, both) for a, b in zip(cuts, cuts[1:]) if a < b)
    return found


def joined(rows: DataFrame) -> DataFrame:
    """a, b: links across components within blocks that meet. rows: key, i, j, block, cid, component, n, shingles."""
    by = ["key", "i", "j"]

    def linked(group: pa.Table) -> Iterator[pa.RecordBatch]:
        cid, component, n, block = (group.column(c).to_numpy() for c in ("cid", "component", "n", "block"))
        _, one = np.unique(cid, return_index=True)  # the central class is in its own block too
        if len(one) > 1:
            lists = group.column("shingles").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            links = trie_links([values[ends[r] : ends[r + 1]] for r in one], n[one], component[one], block[one] if across else None)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[one][a]), pa.array(cid[one][b])], ["a", "b"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in found:
            at = [b.column(b.schema.get_field_index(c)).to_numpy() for c in by]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in at], axis=0)) + 1
            bounds = [0, *cuts.tolist(), b.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                part = b.slice(s, e - s)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in by):
                    yield from linked(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from linked(pa.Table.from_batches(held))

    return rows.select(*by, "block", "cid", "component", "n", "shingles").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def blocks(rows, shingles):
    return F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def first_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in the buckets of each class's first two keys: within blocks, and with the bucket's most central class."""
    two = members.groupBy("cid", "n", "most").agg(F.slice(F.array_sort(F.collect_set("key")), 1, 2).alias("keys")).select("cid", "n", "most", F.explode("keys").alias("key"))
    central = F.min(F.struct((1 - F.col("most") / F.col("n")).alias("own"), "cid", "n"))
    sized = two.groupBy("key").agg(F.count(F.lit(1)).alias("m"), blocks(F.count(F.lit(1)), F.sum("n")).alias("p"), central.alias("hub")).filter("m > 1")
    rows = two.join(sized.select("key", "p"), "key").select("key", "cid", "n", F.pmod(F.xxhash64("cid"), F.col("p")).cast("int").alias("block"))
    hubs = sized.filter("p > 1").select("key", F.col("hub.cid").alias("cid"), F.col("hub.n").alias("n"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("block"))
    dealt = rows.unionByName(hubs).join(sets, "cid")
    return joined(dealt.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "block", "cid", F.col("cid").alias("component"), "n", "shingles"))


def links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that the buckets of members (key, cid, component, n) still hold."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sized = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum("t").alias("total"), F.count(F.lit(1)).alias("spread"), F.max(F.struct("c", "t", "component")).alias("top")).filter("spread > 1")
    sized = sized.select("key", F.col("top.component").alias("largest"), blocks(F.col("top.c"), F.col("top.t")).alias("p"), blocks(F.col("m") - F.col("top.c"), F.col("total") - F.col("top.t")).alias("q"), (blocks(F.col("m"), F.col("total")) == 1).alias("one"))
    rows = members.join(sized, "key").withColumn("main", F.col("component") == F.col("largest"))
    dealt = F.xxhash64("cid")
    block = F.when(F.col("main"), F.pmod(dealt, F.col("p"))).otherwise(F.col("p") + F.pmod(dealt, F.col("q")))
    rows = rows.withColumn("block", F.when(F.col("one"), 0).otherwise(block).cast("int"))
    met = F.when(F.col("one"), F.array(F.lit(0))).otherwise(F.sequence(F.when(F.col("main"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1))
    rows = rows.withColumn("other", F.explode(met)).join(sets, "cid")
    return joined(rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "component", "n", "shingles"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    component_id is the smallest doc_id of the rows reachable over links; a row
    without words has no links. A null doc_id is never the smallest; a component
    of null ids only has a null component_id. Repeated rows are in one component;
    an empty table gives no rows. Other columns are not read.
    """
    rows = common.written(prefixed(docs), "prefixes")
    same = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "key")).alias("one"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = common.written(same.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("cid", F.size("prefix").alias("of"), F.explode("prefix").alias("key"))
    known = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    met = common.written(keyed.join(known, "key"), "met")
    enough = met.groupBy("cid", "of").agg(F.count(F.lit(1)).alias("m")).filter("4 * m >= of").select("cid")
    asked = common.written(enough, "asked")
    sets = common.written(neardup.full_sets(docs, classes.join(asked, "cid")), "sets")
    able = common.written(neardup.sharable(sets).filter(100 * F.col("most") >= PERCENT * F.col("n")), "able")
    members = common.written(met.join(able, "cid").select("key", "cid", "n", "most"), "members")

    links = common.written(first_links(members, sets), "links")
    labels = neardup.components(links)
    named = members.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    new = common.written(links_across(named, sets), "links")
    if not new.isEmpty():
        labels = neardup.components(links.unionByName(new))

    of_class = classes.select("h1", "h2", "cid", "min_id").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = of_class.groupBy("component").agg(F.min("min_id").alias("component_id"))
    of_set = of_class.join(least, "component").select("h1", "h2", "component_id", F.lit(True).alias("linked"))
    out = rows.select("doc_id", "n", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
