"""Throttles and model health in blocks of a key, against rules followed event by event."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import rates


def followed(rows, probe_every, lives, sticky):
    """(key, at, event, degraded, kind, probe) of sorted events, one after the other."""
    state, out = {}, []
    for k, t, e in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        kind, until, probed = state.get(k, ("", None, 0.0))
        if kind and until is not None and t >= until:
            kind, until, probed = "", None, t
        if e == "recovered":
            kind, until, probed = "", None, t
        elif e != "check":
            kind, until, probed = e, t + lives[e] if e in lives else None, t
        probe = kind != "" and kind not in sticky and t - probed >= probe_every
        state[k] = (kind, until, t if probe else probed)
        out.append((k, t, e, kind != "", kind, probe))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "checks", "every", "step"), [(1, 0.5, 900.0, 300), (2, 0.97, 900.0, 100), (3, 0.995, 50.0, 40), (4, 0.995, 5000.0, 20), (5, 0.99, 7.0, 3)])
def test_health_of_a_hot_key(spark, seed, checks, every, step):
    """One key holds most rows and lies in many blocks, some of checks alone."""
    r, t, rows = random.Random(seed), 1e9, []
    for i in range(4000):
        t += r.choice([0, r.random() * step, step / 3])
        event = "check" if r.random() < checks else r.choice(["quota", "no_output", "blocked", "recovered"])
        rows.append((r.choice([7] * 9 + [8, None]), round(t, 6), event if i > 20 else "quota"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = rates.health(spark.createDataFrame(rows, "model long, at double, event string"), "model", every, {"no_output": every * 3}, ("blocked",))
        found = sorted((tuple(x) for x in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == followed(rows, every, {"no_output": every * 3}, ("blocked",))
    assert len({x[5] for x in found}) == 2


def test_health_without_rows_times_or_events(spark):
    schema = "model string, at double, event string, kind int"
    assert rates.health(spark.createDataFrame([], schema), "model").collect() == []
    rows = [("a", None, "quota", 1), ("a", 5.0, None, 2), ("a", 5000.0, "check", 3), (None, 1.0, "quota", 4), (None, 1000.0, "check", 5), (None, 1000.0, "check", 5)]
    got = sorted((tuple(r) for r in rates.health(spark.createDataFrame(rows, schema), "model").collect()), key=repr)
    # an error at an unknown time is never due for a probe; a null event is a check
    assert got == sorted([("a", None, "quota", True, "quota", False), ("a", 5.0, "check", True, "quota", False), ("a", 5000.0, "check", True, "quota", False), (None, 1.0, "quota", True, "quota", False), (None, 1000.0, "check", True, "quota", True), (None, 1000.0, "check", True, "quota", False)], key=repr)


def test_probe_steps():
    assert rates.probe_steps(rates.np.array([0.0, 4.0, 10.0, 14.0, 30.0]), 10.0) == [(10.0, 30.0)]
    assert rates.probe_steps(rates.np.array([0.0, 1.0, 2.0]), 10.0) == [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]


def test_throttle_of_a_hot_key(spark):
    r, rows = random.Random(5), []
    for i in range(3000):
        rows.append((r.choice([1] * 8 + [2, None]), float(r.randrange(6000)), i))
    rows.append((1, None, 3000))
    df = spark.createDataFrame(rows, "k long, at double, id long")
    got = {x["id"]: x["slot"] for x in rates.throttled(df, "k", "at", ["at", "id"], 2.5).collect()}
    last, want = {}, {}
    for k, t, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        slot = None if k not in last and t is None else t if k not in last else max(t or 0.0, last[k] + 2.5)
        want[i] = slot
        if slot is not None:
            last[k] = slot
    assert got == pytest.approx(want)
    assert rates.throttled(df.limit(0), "k", "at", ["at", "id"], 2.5).collect() == []


def test_blocks_split_a_hot_key(spark):
    """A key is split into blocks of like size, and so are equal rows; blocks keep the order."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 2000, 5.0).otherwise(F.col("id").cast("double")).alias("at"))
    sizes = {r["_block"]: (r["n"], r["a"], r["b"]) for r in rates.blocked(df, "k", ["at"]).groupBy("_block").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).collect()}
    assert len(sizes) == 4 and max(n for n, _, _ in sizes.values()) < 1600
    ends = [sizes[b] for b in sorted(sizes)]
    assert all(x[2] <= y[1] for x, y in zip(ends, ends[1:], strict=False))
