"""Rate statistics, throttles, caches with a capacity or an age."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.tables import written


def seconds(ts: str | Column) -> Column:
    """A timestamp without zone as seconds since 1970."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def counts_within(events: DataFrame, key: str, at: str, width: float, span: float) -> DataFrame:
    """Adds `recent`: events of the key in the `width` up to and with each one.

    Rows are dealt by key and cell of `span` (at least `width`); each row also
    goes to the next cell, where it counts but isn't returned, so that a key
    with very many events isn't one task.
    """
    cell = F.floor(F.col(at) / span)
    rows = events.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    # only the end of a cell matters to the next one
    rows = rows.withColumn("_cell", F.when(F.col("_own"), cell).otherwise(cell + 1)).filter(F.col("_own") | (F.col(at) >= F.col("_cell") * span - width))
    w = Window.partitionBy(key, "_cell").orderBy((F.col(at) * 1e6).cast("long")).rangeBetween(-int(width * 1e6), 0)
    return rows.withColumn("recent", F.count(F.lit(1)).over(w)).filter("_own").drop("_own", "_cell")


def blocked(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events with `_block`: ranges of (key, order) of about equal size, one after
    the other, so that a key with very many events lies in several of them. Rows
    that are equal in all of it are dealt by chance. The result is a table: blocks
    stay as they are whatever is computed again.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.withColumn("_chance", F.rand(7)).repartitionByRange(parts, key, *order, "_chance")
    return written(rows.drop("_chance").withColumn("_block", F.spark_partition_id()), "blocks")


def with_starts(rows: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that `starts` holds for their key (also null) and block."""
    other = starts.withColumnsRenamed({key: "_k", "_block": "_b"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")


def throttled(events: DataFrame, key: str, at: str, order: list[str], gap: float) -> DataFrame:
    """Adds `slot`: when each event of a key may go if they keep `gap` apart, in
    closed form: the greatest of earlier times plus the gaps since.

    A key's events are split into blocks. Each is summed up as its number of events
    and its greatest time less the gaps before it; what precedes a block is a
    running sum and a running greatest over these summaries. A null time doesn't
    hold up others. Events that tie in `order` go in any order.
    """
    w = Window.partitionBy(key, "_block").orderBy(*order)
    rows = blocked(events, key, order).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_lead", F.col(at) - F.col("_n") * gap)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_size"), F.max("_lead").alias("_most"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    starts = blocks.select(key, "_block", "_base", F.max(F.col("_most") - F.col("_base") * gap).over(before).alias("_held"))
    lead = F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = with_starts(rows.withColumn("_lead", lead), starts, key)
    slot = F.greatest(F.col("_lead") - F.col("_base") * gap, F.col("_held")) + (F.col("_base") + F.col("_n")) * gap
    return found.withColumn("slot", slot).drop("_block", "_n", "_lead", "_base", "_held")


def reserve(now: float, slots: list[float], most: int, width: float, gap: float, strict: bool) -> float:
    """The slot of a request at `now` given the slots before it (kept to the last `width`).

    As a limiter reads its log: not before the last slot plus `gap`, and with
    `most` slots within `width` not before the oldest of them is that old; with
    `strict` not before the most-th last one is, which holds the cap in bursts too.
    """
    slots[:] = [s for s in slots if s > now - width]
    slot = max(now, slots[-1] + gap) if slots else now
    if len(slots) >= most:
        slot = max(slot, (slots[-most] if strict else slots[0]) + width)
    slots.append(slot)
    return slot


def limited(events: DataFrame, key: str, at: str, most: int, width: float, gap: float, strict: bool = False) -> DataFrame:
    """key, at, slot by a sliding-window limiter, which depends on its own
    results. State is the slots within one width; a key's rows come in sorted
    batches, so a key is never held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = None
        slots: list[float] = []
        for b in batches:
            out = np.empty(len(b))
            for i, (k, t) in enumerate(zip(b[key], b[at], strict=True)):
                if k != current:
                    current, slots = k, []
                out[i] = reserve(t, slots, most, width, gap, strict)
            yield b.assign(slot=out)

    dealt = events.select(key, at).repartition(key).sortWithinPartitions(key, at)
    return dealt.mapInPandas(run, f"{key} {dict(dealt.dtypes)[key]}, {at} double, slot double")


def newest(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key; Spark keeps that many a task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


#: What is known of a model: the kind of its last error, when that ends by itself (0: never), the last error or probe.
State = tuple[str, float, float]
WELL: State = ("", 0.0, 0.0)


def _after(state: State, t: float, event: str, probe_every: float, lives: dict[str, float], sticky: tuple[str, ...]) -> tuple[State, bool]:
    """The state after an event, and whether the model should be tried again."""
    kind, until, probed = state
    if event == "recovered" or (kind and until and t >= until):
        kind, until, probed = "", 0.0, t
    if event not in ("recovered", "check"):
        kind, until, probed = event, t + lives[event] if event in lives else 0.0, t
    probe = bool(kind) and kind not in sticky and t - probed >= probe_every
    return (kind, until, t if probe else probed), probe


def probe_steps(times: np.ndarray, probe_every: float) -> list[tuple[float, float]]:
    """(up to, last) of sorted checks: if the first one due is at `up to` or, after
    the pair before, earlier, then the last probe of the row of checks is `last`.
    Only checks that can be the first one due have a pair."""
    n, j = len(times), len(times)
    last = times.copy()
    for i in range(n - 1, -1, -1):
        while j - 1 > i and times[j - 1] - times[i] >= probe_every:
            j -= 1
        if j < n and times[j] - times[i] >= probe_every:
            last[i] = last[j]
    steps: list[tuple[float, float]] = []
    for t, end in zip(times, last, strict=True):
        if steps and steps[-1][1] == end:
            steps[-1] = (t, end)
        else:
            steps.append((t, end))
        if t - times[0] >= probe_every:  # a probe before this block is no later than its first check
            break
    return steps


def health(events: DataFrame, key: str, probe_every: float = 900.0, ttl: dict[str, float] | None = None, sticky: tuple[str, ...] = ()) -> DataFrame:
    """key, at, event, degraded, kind, probe after each event of a model, in time.

    Events: an error kind degrades, `recovered` ends that, `check` only looks. A
    kind with a time to live ends by itself after it, at the next event. `probe`
    tells that the model should be tried again: degraded, not of a sticky kind,
    and probe_every since the last error or probe. Events without a time come
    first and never probe; a null event is a check.

    A model's events are split into blocks, so one with very many isn't one task.
    A block that holds an error or a recovery ends in a state that nothing before
    it changes. One of checks alone maps the last probe before it to the last one
    in it, a step function (`probe_steps`). These summaries are followed block by
    block, as a sorted stream, and then each block runs from its own start.
    """
    lives = {"no_output": 60.0} if ttl is None else ttl
    named = f"{key} {dict(events.dtypes)[key]}, _block int"
    state = "kind string, until double, probed double"
    rows = blocked(events.select(key, "at", F.coalesce("event", F.lit("check")).alias("event")), key, ["at", "event"])
    dealt = rows.repartition(key, "_block").sortWithinPartitions(key, "_block", "at", "event")
    same = lambda a, b: a is not None and a[1] == b[1] and (a[0] == b[0] or (pd.isna(a[0]) and pd.isna(b[0])))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: Any = None
        now, fixed, times = WELL, False, []

        def rows_of() -> list[tuple]:
            if fixed:
                return [(*place, True, *now, None, None, None)]
            steps = probe_steps(np.array(times), probe_every) if times else [(None, None)]
            end = times[-1] if times else None
            return [(*place, False, "", 0.0, 0.0, end, *s) for s in steps]

        names = [key, "_block", "fixed", "kind", "until", "probed", "ends", "upto", "last"]
        for b in batches:
            out: list[tuple] = []
            for k, n, t, e in zip(b[key], b["_block"], b["at"], b["event"], strict=True):
                if not same(place, (k, n)):
                    out += rows_of() if place is not None else []
                    place, now, fixed, times = (k, n), WELL, False, []
                if fixed or e != "check":
                    now, fixed, times = _after(now, t, e, probe_every, lives, sticky)[0], True, []
                elif t == t:
                    times.append(t)
            yield pd.DataFrame(out, columns=names)
        if place is not None:
            yield pd.DataFrame(rows_of(), columns=names)

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = None
        now, after = WELL, WELL
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                k, n, fixed, kind, until, probed, ends, upto, last = r
                if not same(current, (k, n)):
                    now = after if current is not None and same((current[0], 0), (k, 0)) else WELL
                    current, after = (k, n), now
                    out.append((k, n, *now))
                    if fixed:
                        after = (kind, until, probed)
                    elif now[0] and now[1] and ends >= now[1]:
                        after = ("", 0.0, ends)
                if not fixed and after == now and now[0] and now[0] not in sticky and upto - now[2] >= probe_every:
                    after = (now[0], now[1], last)  # the first step that reaches so far
            yield pd.DataFrame(out, columns=[key, "_block", "kind", "until", "probed"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: Any = None
        now = WELL
        for b in batches:
            out = []
            for k, n, t, e, *start in zip(b[key], b["_block"], b["at"], b["event"], b["kind"], b["until"], b["probed"], strict=True):
                if not same(place, (k, n)):
                    place, now = (k, n), tuple(start)
                now, probe = _after(now, t, e, probe_every, lives, sticky)
                out.append((bool(now[0]), now[0], probe))
            yield b[[key, "at", "event"]].assign(**{c: [o[i] for o in out] for i, c in enumerate(("degraded", "kind", "probe"))})

    sums = dealt.mapInPandas(summed, f"{named}, fixed boolean, {state}, ends double, upto double, last double")
    starts = sums.repartition(key).sortWithinPartitions(key, "_block", "upto").mapInPandas(followed, f"{named}, {state}")
    begun = with_starts(rows, starts, key).repartition(key, "_block").sortWithinPartitions(key, "_block", "at", "event")
    return begun.mapInPandas(run, f"{key} {dict(events.dtypes)[key]}, at double, event string, degraded boolean, kind string, probe boolean")
