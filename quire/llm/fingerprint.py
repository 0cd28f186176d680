"""Document fingerprints: one-permutation MinHash with optimal densification.

A text's five-word shingles are hashed once. The top bits of a hash choose one
of the bins and the smallest hash of a bin stands for it. An empty bin borrows
from a bin that a hash of (bin, attempt) chooses, attempt by attempt until one
is full, so that borrowing is as random as fresh hashing. The low byte of each
bin is stored. Two different values share a low byte with probability 1/256;
the estimate of the Jaccard similarity takes that out.

All of it is column expressions. `let` binds a value once for a later
expression, which Spark would otherwise repeat inside each lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common

BIN_BITS, WIDTH, ATTEMPTS = 7, 5, 6
BINS = 1 << BIN_BITS
CHANCE = 1 / 256
SPACE = " \t\n\x0b\x0c\r"
MOST_RANGES = 16384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words of the lower-cased text; of the whole
    sequence if there are fewer words; null without words."""
    words = F.transform(F.split(F.btrim(F.lower(text), F.lit(SPACE)), "[ \\t-\\r]+"), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]))
    found = let(words, lambda h: F.when(F.size(h) >= WIDTH, runs(h)).otherwise(F.array(F.xxhash64(h))))
    return F.when(F.length(F.btrim(text, F.lit(SPACE))) > 0, found)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def densified(least: Column) -> Column:
    """BINS values from the least hashes of the bins that have any."""

    def borrow(filled: Column, b: Column) -> Column:
        tries = [F.element_at(filled, F.pmod(F.xxhash64(b, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(ATTEMPTS)]
        # further attempts go through the bins in an order of their own for each b: the first full one
        last = F.array_min(F.transform(F.map_entries(filled), lambda e: F.struct(F.xxhash64(b, e["key"], F.lit(ATTEMPTS)).alias("order"), e["value"].alias("value"))))
        return F.coalesce(F.element_at(filled, b), *tries, last["value"])

    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    return let(F.map_from_arrays(F.transform(least, bin_of), least), lambda filled: F.transform(bins, lambda b: borrow(filled, b)))


def codes(text: Column) -> Column:
    """The low byte of each bin, as array<tinyint>; null for a text without words."""

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    low = lambda values: F.transform(values, lambda v: (v.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    return let(F.sort_array(shingle_hashes(text)), lambda ordered: F.when(ordered.isNotNull(), low(densified(let(ordered, least)))))


def fingerprint(code: Column) -> Column:
    """Two hexadecimal digits a bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c.cast("int") + 128), 2, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts, 0 to 1; of two texts without words 1."""
    agreed = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(BINS))
    estimate = F.greatest(F.lit(0.0), (agreed - CHANCE) / (1 - CHANCE))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row in
    descending doc_id, after the last row that of the first.

    Rows are dealt by ranges of doc_id, whose ends are ids that occur; the rows
    at a range's upper end go to the range above as well, where they follow its
    last row. Nothing but the ends of ranges passes the driver.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ranges = min(MOST_RANGES, 8 * common.partitions(docs.sparkSession))
    ends, top = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges), F.max("k")).first()
    bounds = sorted({*(ends or []), top}) if top is not None else [0]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fits = lambda p, s: (p + s <= len(bounds)) & (F.get(array, p + s - 1) < F.col("_key"))
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(fits(p, s), p + s).otherwise(p))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("helps"))
    above = F.struct(F.pmod(F.col("_range") + 1, F.lit(len(bounds))).alias("range"), F.lit(1).alias("helps"))
    placed = docs.withColumn("_key", key).withColumn("_range", below)
    placed = placed.withColumn("_at", F.explode(F.when(F.get(array, F.col("_range")) == F.col("_key"), F.array(own, above)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.range").orderBy("_at.helps", F.desc("_key"), "text")
    found = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return found.filter("_at.helps = 0").drop("_key", "_range", "_at")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points, rounded down,
    replaced by as many first ones of the next document in descending doc_id. A
    null text counts as empty; a text without words has the empty fingerprint.
    Rows of equal ids follow each other by text, null ids come last; a single
    row is followed by itself; an empty table gives no rows. Other columns are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("codes", codes(F.col("text"))), ["text", "codes"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "codes", "next_codes", edited.alias("edited"))
    rows = rows.withColumns({"edited_codes": codes(F.col("edited")), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("codes")).alias("fingerprint"), fingerprint(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
