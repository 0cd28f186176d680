"""Sharding by balanced label propagation over links between equal texts.

Labels are shards. They start balanced and without regard to links: documents
are dealt in order of a hash of their ids, so that shards differ by one row at
most. Then, round by round, documents move towards the shards that hold most of
their neighbours. A shard pair exchanges as many documents each way, which keeps
the law that counts differ by one at most: whoever wants to move from s to t
swaps with someone who wants to move from t to s, or with an unlinked document
of t, for which all shards are alike. Moves beyond these quotas wait for the
next round. Rounds go on until no link is mended any more.

Neighbourhoods of equal texts are complete, so what a document has to know of
its neighbours is the number of them in each shard: a table of (text, shard)
counts, never a list of pairs. A text with very many copies adds at most
`shards` rows to it. A text with as many copies as a shard has rows gets whole
shards first, and only what is left of it is propagated with all others, so no
home is full of a text that small groups have to share it with. A home that has
no row left to give is full; who can't get in tries the next best of the shards
that aren't. Members of a home never leave it, so a move only ever joins a larger
part, and the rounds come to an end. Ties go by hashes of ids and texts: how rows
are partitioned plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common

#: Rows that a task ranks, about, and the most rows of the table of counts in between.
RANKED, MOST_BUCKETS = 100_000, 1 << 16
SALTS = 16


def documents_as_nodes(docs: DataFrame, fixed: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus `fixed`), text_crc32, group (of equal texts; nulls are one group)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + fixed).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.octet_length("text")).alias("group"),
    )


def buckets(rows: int, groups: int = 1) -> int:
    """Into how many parts each of some groups is dealt for ranks."""
    return max(16, min(MOST_BUCKETS // groups, -(-rows // (RANKED * groups))))


def drawn() -> Column:
    """What orders rows that are alike to the law; those that share it are the same row."""
    return F.xxhash64("doc_id", "group")


def whole_shards(nodes: DataFrame, shards: int, total: int) -> tuple[DataFrame | None, int]:
    """node, shard of the rows of large texts that fill whole shards, and the number of those, from 0."""
    base, more = divmod(total, shards)
    if not base:
        return None, 0
    # fewer than twice as many rows as shards
    large = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= base).orderBy(F.desc("n"), "group").collect()
    plan, used = [], 0
    for r in large:
        at = 0
        while used < shards and r["n"] - at >= (size := base + (used < more)):
            plan.append((r["group"], at, at + size, used))
            at, used = at + size, used + 1
    if not plan:
        return None, 0
    spans = nodes.sparkSession.createDataFrame(plan, "group long, start long, end long, shard int")  # `shards` rows at most
    mine = nodes.join(F.broadcast(spans.select("group").distinct()), "group")
    ranked = common.with_rank(mine, ["group"], [drawn(), F.col("node")], F.struct("doc_id", "node"), "rank", buckets=buckets(total, len(large)))
    return ranked.join(F.broadcast(spans), "group").filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))).select("node", "shard"), used


def first_labels(nodes: DataFrame, shards: int, total: int, first: int = 0) -> DataFrame:
    """Labels in order of a hash of ids, dealt out in turn: counts one apart at most."""
    linked = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # rows of one group meet its size in several places, so that a very common text isn't one task
    linked = linked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.struct("doc_id", "group")
    ranked = common.with_rank(nodes.select("node", "doc_id", "group"), [], [drawn(), F.col("node")], spread, "rank", buckets=buckets(total))
    ranked = ranked.withColumn("shard", (first + F.pmod("rank", F.lit(shards))).cast("int")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return ranked.join(linked, ["group", "salt"], "left").select("node", "doc_id", "group", F.coalesce("members", F.lit(1)).alias("members"), "shard")


def held(labels: DataFrame) -> DataFrame:
    """group, members, shard, here: how many of a group's rows a shard has, for groups of two rows and more."""
    return labels.filter("members > 1").groupBy("group", "members", "shard").agg(F.count(F.lit(1)).alias("here"))


def mended(labels: DataFrame) -> tuple[int, int]:
    """Links cut and links whole, of all pairs of equal texts."""
    pairs = lambda n: n * (n - 1) / 2
    by_group = held(labels).groupBy("group", "members").agg(F.sum(pairs(F.col("here").cast("decimal(19,0)"))).alias("whole"))
    row = by_group.agg(F.sum("whole"), F.sum(pairs(F.col("members").cast("decimal(19,0)")))).first()
    whole, all_ = (int(x or 0) for x in row)
    return all_ - whole, whole


def wishes(labels: DataFrame, shards: int, capacity: int) -> DataFrame:
    """group, shard, targets (an array to choose from), gain: where the members
    of a group in a shard would go. Homes of a group are its first shards by
    (here, hash), as many as its size needs."""
    by_size = [F.desc("here"), F.xxhash64("group", "shard"), F.col("shard")]
    of = Window.partitionBy("group")  # a row a shard
    needed = F.ceil(F.col("members") / capacity)
    ranked = held(labels).withColumn("place", F.row_number().over(of.orderBy(*by_size))).withColumn("home", F.col("place") <= needed)
    settled = ranked.filter("home").groupBy("shard").agg(F.sum("here").alias("settled"))
    sizes = labels.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    full = sizes.join(settled, "shard").filter("settled >= rows").select("shard", F.lit(True).alias("full"))  # `shards` rows at most
    ranked = ranked.join(F.broadcast(full), "shard", "left").withColumn("open", F.col("full").isNull())
    ranked = ranked.withColumn("nth", F.sum(F.col("open").cast("int")).over(of.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    # homes that have room, else the next best shards that do; only those before a shard draw its members
    target = F.when(F.col("open") & (F.col("nth") <= needed), F.struct("place", "shard"))
    ranked = ranked.withColumn("all", F.array_sort(F.collect_list(target).over(of)))
    targets = F.transform(F.filter("all", lambda t: t["place"] < F.col("place")), lambda t: t["shard"])
    return ranked.filter(~F.col("home")).select("group", "shard", targets.alias("targets"), F.col("members").alias("gain")).filter(F.size("targets") > 0)


def propagate(labels: DataFrame, shards: int, total: int) -> DataFrame:
    """One round: moves towards the neighbours' shards, within swap quotas."""
    wish = wishes(labels, shards, max(1, total // shards))
    wishing = labels.filter("members > 1").join(wish, ["group", "shard"])
    # of several homes, each member draws one
    target = F.get("targets", F.pmod(drawn(), F.size("targets")).cast("int"))
    wishing = wishing.withColumn("target", target).drop("targets")
    parts = buckets(total, shards * shards)
    wishing = common.with_rank(wishing, ["shard", "target"], [F.desc("gain"), F.col("group"), drawn(), F.col("node")], F.col("group"), "rank", buckets=parts)
    demand = wishing.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("want"))
    back = demand.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("want").alias("returning"))
    free = common.with_rank(labels.filter("members = 1"), ["shard"], [drawn(), F.col("node")], F.struct("doc_id", "group"), "rank", buckets=buckets(total, shards))
    stock = free.groupBy(F.col("shard").alias("target")).agg(F.count(F.lit(1)).alias("free"))
    # shards * shards rows at most: the free documents of a target go to the sources in order
    pairs = demand.join(back, ["shard", "target"], "left").join(stock, "target", "left").fillna(0, ["returning", "free"])
    pairs = pairs.withColumn("extra", F.greatest(F.col("want") - F.col("returning"), F.lit(0)))
    before = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("from", F.coalesce(F.sum("extra").over(before), F.lit(0)))
    pairs = pairs.withColumn("given", F.greatest(F.least(F.col("extra"), F.col("free") - F.col("from")), F.lit(0)))
    pairs = common.written(pairs.withColumn("quota", F.least("want", "returning") + F.col("given")), "quotas")
    moves = wishing.join(F.broadcast(pairs.select("shard", "target", "quota")), ["shard", "target"]).filter(F.col("rank") < F.col("quota")).select("node", F.col("target").alias("to"))
    swaps = pairs.filter("given > 0").groupBy(F.col("target").alias("shard")).agg(F.collect_list(F.struct("from", "given", F.col("shard").alias("to"))).alias("swaps"))
    found = F.get(F.filter("swaps", lambda s: (F.col("rank") >= s["from"]) & (F.col("rank") < s["from"] + s["given"])), F.lit(0))
    freed = free.join(F.broadcast(swaps), "shard").select("node", found["to"].alias("to")).filter("to is not null")
    moved = labels.join(moves.unionByName(freed), "node", "left")
    return moved.select("node", "doc_id", "group", "members", F.coalesce("to", "shard").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 12, trace: list | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `rows`: counts of shards are one apart at most. Slots run from 0
    without gaps. Rows of equal texts (nulls are alike) are linked. Rounds end
    when no more links are whole than before, after `rounds` at the latest;
    `trace` gets the numbers of links cut and whole before each, of the rows that
    don't fill whole shards with one text. Repeated rows
    are rows of their own, a null doc_id sorts first, an empty table gives no
    rows. Other columns are not read.
    """
    nodes = common.written(documents_as_nodes(docs).withColumn("node", F.monotonically_increasing_id()), "nodes")
    total, trace = nodes.count(), [] if trace is None else trace
    filled, used = whole_shards(nodes, shards, total)
    rest, open_ = nodes, max(1, shards - used)
    if filled is not None:
        filled = common.written(filled, "filled")
        rest = common.written(nodes.join(filled.select("node"), "node", "left_anti"), "rest")
        total = rest.count()
    labels = common.written(first_labels(rest, open_, total, used), "labels")
    trace.append(mended(labels))
    for _ in range(rounds):
        if not trace[-1][0]:
            break
        labels = common.written(propagate(labels, open_, total), "labels")
        trace.append(mended(labels))
        if trace[-1][1] <= trace[-2][1]:
            break
    homes = labels.select("node", "shard")
    rows = nodes.join(homes if filled is None else homes.unionByName(filled), "node")
    slotted = common.with_rank(rows, ["shard"], [F.col("doc_id"), F.col("node")], F.col("node"), "slot", buckets=buckets(total, shards))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
