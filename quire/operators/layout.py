"""Page layout over word and line rows: margins, gutters, paragraphs, order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 120


def upper_median(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """The upper median of c, by page."""
    ordered = F.sort_array(F.collect_list(c))
    return df.groupBy(*by).agg(F.get(ordered, F.floor(F.count(c) / 2).cast("int")).alias("median"))


def coverage(words: DataFrame, by: list[str], width: float, bins: int = BINS) -> DataFrame:
    """by, bin, ink: each word (x0, x1) adds its width to every bin it spans."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = words.filter("x1 >= x0").select(*by, (F.col("x1") - F.col("x0")).alias("w"), F.explode(F.sequence(at("x0"), at("x1"))).alias("bin"))
    return rows.groupBy(*by, "bin").agg(F.sum("w").alias("ink"))


def longest_gap(bins_: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """by, start, length: the longest run of empty bins between filled ones, the first of equals."""
    w = Window.partitionBy(*by).orderBy("bin")
    gaps = bins_.filter("ink > 0").withColumn("next", F.lead("bin").over(w)).withColumn("length", F.col("next") - F.col("bin") - 1).filter("length > 0")
    top = gaps.groupBy(*by).agg(F.max(F.struct("length", (-F.col("bin")).alias("b"))).alias("t"))
    return top.select(*by, (1 - F.col("t.b")).alias("start"), F.col("t.length").alias("length"))


def blocks(lines: DataFrame, by: list[str], indent: tuple[float, float] = (3.0, 40.0), gap: float = 5.0, fragment: int = 4) -> DataFrame:
    """Adds block to lines (top, bottom, x0, x1, text): a new one starts at an indent
    against the block's margin or a gap below the last line that isn't a fragment."""
    order = Window.partitionBy(*by).orderBy("top", "x0")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    solid = F.length("text") >= fragment
    rows = lines.withColumn("_bottom", F.last(F.when(solid, F.col("bottom")), True).over(before)).withColumn("_x0", F.last(F.when(solid, F.col("x0")), True).over(before))
    shift = F.col("x0") - F.col("_x0")
    starts = F.col("_bottom").isNull() | (solid & (shift.between(*indent) | (F.col("top") - F.col("_bottom") >= gap)))
    return rows.withColumn("block", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_bottom", "_x0")


def block_texts(lines: DataFrame, by: list[str]) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "x0", "text"))), lambda s: s["text"]), " ")
    return lines.groupBy(*by, "block").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), text.alias("text"))


def merged_intervals(lines: DataFrame, by: list[str], slack: float = 0.5) -> DataFrame:
    """by, top, bottom: lines merged as long as the next top is within the bottom so far plus slack."""
    order = Window.partitionBy(*by).orderBy("top", "bottom")
    reach = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("_new", (F.col("top") > reach + slack) | reach.isNull())
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_run").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("_run")


def runs(lines: DataFrame, by: list[str], order: str, flag: Column, most: int) -> DataFrame:
    """by, first, last: runs of flagged lines, cut at `most`."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = lines.withColumn("_n", F.row_number().over(w)).filter(flag)
    rows = rows.withColumn("_run", F.col("_n") - F.row_number().over(w))
    inside = Window.partitionBy(*by, "_run").orderBy(order)
    rows = rows.withColumn("_part", F.floor((F.row_number().over(inside) - 1) / most))
    return rows.groupBy(*by, "_run", "_part").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run", "_part")


def next_top(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Adds next_top: of the next box below in the same column, else in any."""
    col_ = Window.partitionBy(*by, "col").orderBy("top").rangeBetween(1, Window.unboundedFollowing)
    any_ = Window.partitionBy(*by).orderBy("top").rangeBetween(1, Window.unboundedFollowing)
    return boxes.withColumn("next_top", F.coalesce(F.min("top").over(col_), F.min("top").over(any_)))


def reading_order(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Adds i from 0: front, top left, left, top right, right, then what spans the page, each from the top."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("front", "topleft", "left", "topright", "right", "span")) for x in (k, i)]), F.col("place"))
    return boxes.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(rank, "top", "x0")) - 1)


def first_of_repeated(chars: DataFrame, by: list[str]) -> DataFrame:
    """Characters (x0, x1, char, pos) without later ones at the same rounded place."""
    key = [*by, F.round("x0").alias("_a"), F.round("x1").alias("_b"), "char"]
    rest = [c for c in chars.columns if c not in (*by, "char")]
    top = chars.groupBy(*key).agg(F.min_by(F.struct(*rest), "pos").alias("_r"))
    return top.select(*by, "char", *[F.col(f"_r.{c}").alias(c) for c in rest])


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, by: list[str], slack: float = 1.5) -> DataFrame:
    """Lines (line, x0, x1, top, bottom) with the box (box, x0, x1, top, bottom) that holds their
    vertical centre and overlaps them; boxes of a page are few."""
    b = boxes.select(*by, "box", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "top", "bottom")])
    mid = (F.col("top") + F.col("bottom")) / 2
    held = (mid >= F.col("b_top") - slack) & (mid <= F.col("b_bottom") + slack) & (F.col("x0") < F.col("b_x1")) & (F.col("x1") > F.col("b_x0"))
    return lines.join(b, by).filter(held).select(*by, "line", "box")


def ink_box(strokes: DataFrame, by: list[str]) -> DataFrame:
    """by and x0, y0, x1, y1 around strokes (points: x and y in turn), null without a finite pair."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("points") / 2).cast("int") - 1), lambda i: F.struct(F.get("points", 2 * i).alias("x"), F.get("points", 2 * i + 1).alias("y")))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = F.when(F.size("points") >= 2, F.filter(pairs, lambda p: finite(p["x"]) & finite(p["y"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    rows = strokes.select(*by, F.explode_outer(points).alias("p"))
    return rows.groupBy(*by).agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


def attached(lines: DataFrame, by: list[str], share: float = 0.6) -> DataFrame:
    """Adds host: the line (line, top, bottom, x0, x1) a superscript belongs to,
    which overlaps it by `share` of its height and spans it, or null. The rule
    depends on which lines were attached before, so a task reads sorted pages as a
    stream and holds one line; lines at one place go by number."""

    number = lambda b, c: pc.fill_null(b.column(c).cast(pa.float64()), float("nan")).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = last = None
        for b in batches:
            hosts = []
            for of, line, top, bottom, x0, x1 in zip(zip(*(b.column(c).to_pylist() for c in by)), b.column("line").to_pylist(), *(number(b, c) for c in ("top", "bottom", "x0", "x1"))):
                if of != page:
                    page, last = of, None
                height = max(bottom - top, 1e-9)
                over = 0.0 if last is None else (min(bottom, last[2]) - max(top, last[1])) / height
                if last is not None and over >= share and x0 >= last[3] and x1 <= last[4]:
                    hosts.append(last[0])
                else:
                    hosts.append(None)
                    last = line, top, bottom, x0, x1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hosts, pa.int64())], names=[*b.schema.names, "host"])

    kinds = ", ".join(f"{c} {k}" for c, k in lines.dtypes)
    ordered = lines.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("top"), F.asc_nulls_last("x0"), "line")
    return ordered.mapInArrow(run, f"{kinds}, host long")


def snapped(cuts: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Cuts (y) moved to the nearer edge of the line interval (top, bottom) they
    would cut, ties to the top. Intervals don't overlap, so a cut meets one at most."""
    i = intervals.select(*by, F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    inside = (F.col("y") > F.col("_t")) & (F.col("y") < F.col("_b"))
    on = inside
    for c in by:
        on = on & (cuts[c] == i[c])
    rows = cuts.join(i, on, "left").select(*[cuts[c] for c in cuts.columns], "_t", "_b")
    y = F.when(F.col("_t").isNull(), F.col("y")).when(F.col("y") - F.col("_t") <= F.col("_b") - F.col("y"), F.col("_t")).otherwise(F.col("_b"))
    return rows.withColumn("snapped", y).drop("_t", "_b")


def clamped(box: Column, width: float, height: float, pad: float) -> Column:
    """A padded box (array of four) inside the page."""
    side = lambda i, d, most: F.least(F.greatest(F.get(box, F.lit(i)) + d, F.lit(0.0)), F.lit(float(most)))
    return F.array(side(0, -pad, width), side(1, -pad, height), side(2, pad, width), side(3, pad, height))


def table_regions(words: DataFrame, by: list[str], gap: float = 16.0, least: int = 2, numeric: int = 2) -> DataFrame:
    """by, top, bottom, bands: runs of table-like bands of words (band, top,
    bottom, text), that is bands with a number and without four words of prose,
    close enough to each other, as long as enough of them are numeric."""
    prose = F.regexp_count("text", F.lit(r"(?<![A-Za-z])[A-Z]?[a-z]{3,}(?![A-Za-z])"))
    bands = words.groupBy(*by, "band").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sum(prose).alias("prose"),
        F.count_if(F.col("text").rlike(r"\d")).alias("numbers"), F.count_if(F.length(F.regexp_replace("text", r"\D", "")) >= 3).alias("long_numbers"),
    )
    w = Window.partitionBy(*by).orderBy("top")
    like = (F.col("prose") < 4) & (F.col("numbers") >= 1)
    rows = bands.withColumn("_like", like).withColumn("_after", F.lag("_like").over(w) & (F.col("top") - F.lag("bottom").over(w) <= gap))
    rows = rows.withColumn("_run", F.sum((~F.coalesce("_after", F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_like")
    found = rows.groupBy(*by, "_run").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("bands"), F.count_if(F.col("long_numbers") >= 1).alias("_numeric"))
    return found.filter((F.col("bands") >= least) & (F.col("_numeric") >= numeric)).select(*by, "top", "bottom", "bands")


def merged_fragments(boxes: DataFrame, by: list[str], gap: float = 5.0, fragile: int = 4) -> DataFrame:
    """Boxes (i, kind, col, split, x0, top, x1, bottom, text) of a page with those
    joined to the one before that a band has cut off (it only starts there, in the
    same column, body to body, closer than `gap`), and then stray short ones to
    the right of the one before in its column. Each join changes what the next
    box is held against, so a task reads sorted pages as a stream and holds two boxes."""

    nan = float("nan")
    at = lambda b, c: nan if b[c] is None else b[c]
    most = lambda p, b, c: None if (m := max(at(p, c), at(b, c))) != m else m

    def join(rows: Iterator[dict | None], cut) -> Iterator[dict | None]:
        p = None  # None ends a page
        for b in rows:
            if p is not None and b is not None and cut(p, b):
                p["text"] = f"{p['text']}\n{b['text']}".strip()
                p["x1"], p["bottom"] = most(p, b, "x1"), most(p, b, "bottom")
                continue
            if p is not None:
                yield p
            p = b
            if b is None:
                yield None

    def band(p: dict, b: dict) -> bool:
        return b["split"] == "start" and p["col"] == b["col"] and p["kind"] == b["kind"] == "body" and at(b, "top") - at(p, "bottom") < gap

    def stray(p: dict, b: dict) -> bool:
        return len(b["text"].strip()) < fragile and b["kind"] == "body" and p["col"] == b["col"] and at(b, "x0") > at(p, "x0") + 1.0

    def pages(batches: Iterator[pa.RecordBatch], schemas: list[pa.Schema]) -> Iterator[dict | None]:
        page = None
        for batch in batches:
            schemas[:] = [batch.schema]
            for b in batch.to_pylist():
                if page is not None and page != (page := tuple(b[c] for c in by)):
                    yield None
                page = page or tuple(b[c] for c in by)
                yield b
        yield None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, i, schemas = [], 0, []
        for b in join(join(pages(batches, schemas), band), stray):
            if b is None:
                i = 0
                continue
            out.append({**b, "i": i})
            i += 1
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schemas[0])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schemas[0])

    ordered = boxes.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("i"))
    return ordered.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in boxes.dtypes))


def inked(words: DataFrame, by: list[str], width: float, faint: float = 0.5) -> DataFrame:
    """by, low, high: bits of the bins (0 to 59, 60 to 119) with more than `faint`
    ink. A word wider than that fills its bins alone, so bits are or-ed before the
    shuffle; only narrower words are summed by bin."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) / width * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    w = F.col("x1") - F.col("x0")
    rows = words.filter("x1 >= x0").select(*by, w.alias("_w"), at("x0").alias("_a"), at("x1").alias("_b"))
    # a wide word has no bin, a narrow one a row for each
    rows = rows.select("*", F.explode(F.when(F.col("_w") > faint, F.array(F.lit(None).cast("int"))).otherwise(F.sequence("_a", "_b"))).alias("_bin"))
    bits = lambda o: F.expr(f"if(_bin is null, shiftleft(shiftleft(1L, greatest(least(_b, {o + 59}) - greatest(_a, {o}) + 1, 0)) - 1L, greatest(_a - {o}, 0) % 60), if(_bin between {o} and {o + 59}, shiftleft(1L, _bin % 60), 0L))")
    rows = rows.groupBy(*by, "_bin").agg(F.bit_or(bits(0)).alias("low"), F.bit_or(bits(60)).alias("high"), F.sum("_w").alias("_ink"))
    return rows.filter(F.col("_bin").isNull() | (F.col("_ink") > faint)).groupBy(*by).agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))


def bins_between(first: str, last: str) -> Column:
    """The inked bins from first to last, of bits low and high."""
    return F.expr(f"filter(sequence({first}, {last}), b -> (shiftright(if(b < 60, low, high), b % 60) & 1L) = 1L)")


def widest_gap(words: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, start, length: the longest run of bins with next to no ink in the
    middle 70 % of the width, the first of equals; its borders count as ink."""
    lo, hi = int(BINS * 0.15), int(BINS * 0.85)
    # bins as a string of 0 and 1, the first at the left: the greatest of the strings between ones is the longest
    bits = lambda c: F.reverse(F.lpad(F.bin(c), 60, "0"))
    rows = inked(words, by, width).select(*by, F.substring(F.concat(bits("low"), bits("high")), lo + 1, hi - lo).alias("_bins"))
    rows = rows.withColumn("_gap", F.array_max(F.split("_bins", "1+")))
    return rows.select(*by, (lo - 1 + F.instr("_bins", F.col("_gap"))).alias("start"), F.length("_gap").alias("length"))


def joined(rows: DataFrame, found: DataFrame, by: list[str], band: str | None = None) -> DataFrame:
    return rows.join(found, by if band is None else [*by, band])


def column_gap(words: DataFrame, by: list[str], width: float, height: float, y_split: float | Column, met: Callable[..., DataFrame] = joined) -> DataFrame:
    """by, x_mid: the middle of the gutter below y_split that most bands agree on.

    Words have x0, x1, top. A band votes if it has six words, a gap of two bins
    in the middle 70 % of the width, and three words on each side of it. Three
    votes make a gutter, with eight words of the page on each side; of equal
    numbers of votes the one of the upper band counts. `met` joins words with what is found of pages or their bands.
    """
    high = max(8.0, height / 40)
    banded = words.filter((F.col("top") >= y_split) & (F.col("top") < height)).withColumn("_band", F.floor((F.col("top") - y_split) / high).cast("int"))
    key = [*by, "_band"]
    found = widest_gap(banded, key, width).filter("length >= 2").select(*key, (F.col("start") + F.col("length") / 2).alias("_mid"))
    at = F.col("_mid") * width / BINS
    sides = met(banded, found, by, "_band").groupBy(*key, "_mid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x1") <= at).alias("left"), F.count_if(F.col("x0") >= at).alias("right"))
    votes = sides.filter("n >= 6 and left >= 3 and right >= 3").groupBy(*by, F.bround("_mid").cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("votes"), F.min("_band").alias("first"))
    top = votes.groupBy(*by).agg(F.max(F.struct("votes", (-F.col("first")).alias("first"), "_bin")).alias("_t")).filter("_t.votes >= 3").select(*by, (F.col("_t._bin") * width / BINS).alias("x_mid"))
    held = met(words, top, by).groupBy(*by, "x_mid").agg(F.count_if(F.col("x1") <= F.col("x_mid") + 1).alias("left"), F.count_if(F.col("x0") >= F.col("x_mid") - 1).alias("right"))
    return held.filter("left >= 8 and right >= 8").select(*by, "x_mid")


def dominant_sizes(words: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, box, size: the size to one decimal that most characters in a box have, 0 without any.

    words (pos, text, size, x0, x1, top, bottom) belong to a box (box, x0, x1, top,
    bottom) by their centre, borders included; a blank text weighs one character.
    Ties go to the size that is met first by pos, then to the smaller. Null or sizes of 0 don't count.
    Boxes of a page are few.
    """
    b = boxes.select(*by, "box", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "top", "bottom")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    sized = words.withColumn("size", F.bround("size", 1)).filter("size > 0")
    held = sized.join(b, by).filter(x.between(F.col("b_x0"), F.col("b_x1")) & y.between(F.col("b_top"), F.col("b_bottom")))
    weight = F.greatest(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))), F.lit(1))
    sums = held.groupBy(*by, "box", "size").agg(F.sum(weight).alias("w"), F.min("pos").alias("first"))
    top = sums.groupBy(*by, "box").agg(F.max_by("size", F.struct("w", -F.col("first"), -F.col("size"))).alias("size"))
    return boxes.select(*by, "box").join(top, [*by, "box"], "left").select(*by, "box", F.coalesce("size", F.lit(0.0)).alias("size"))
