"""Spaces from the distances of characters."""

import random

import pyarrow as pa

from quire.functions import spacing
from quire.functions.spacing import healed, healed_batch, healed_text


def chars(words, gap, inner=0.0, size=9.0):
    out, x = [], 0.0
    for w in words:
        for c in w:
            out.append({"x0": x, "x1": x + 5.0, "size": size, "char": c})
            x += 5.0 + inner
        x += gap
    return out


GIVEN = "where the constants of the piezoelectric layer are known".split()


def test_spaces_are_found_again():
    glued = "".join(GIVEN)
    assert healed_text(glued, chars(GIVEN, 1.4)) == " ".join(GIVEN)
    assert healed_text(glued, chars(GIVEN, 1.4, 0.2)) == " ".join(GIVEN)  # letters apart, too
    doubled = [c for c in chars(GIVEN, 1.4) for _ in range(2)]
    assert healed_text(glued, doubled) == " ".join(GIVEN)
    assert healed_text(glued, chars(GIVEN, 0.2)) == glued  # too close
    assert healed_text(glued + "x", chars(GIVEN, 1.4)) == glued + "x"  # other characters
    assert healed_text(glued, chars(GIVEN, 1.4, size=0.0)) == glued
    assert healed_text(" ".join(GIVEN), chars(GIVEN, 1.4)) == " ".join(GIVEN)


def test_odd_lines(spark):
    many = ["the"] * 20_000
    rows = [(0, None, None), (1, "", []), (2, "short", chars(["short"], 1.0)), (3, "".join(GIVEN), chars(GIVEN, 1.4)), (3, "".join(GIVEN), chars(GIVEN, 1.4)), (4, "the" * 20_000, chars(many, 1.4)), (5, "a" * 20, [None, *chars(["a" * 20], 0.0)])]
    df = spark.createDataFrame(rows, "n int, text string, chars array<struct<x0:double,x1:double,size:double,char:string>>")
    got = sorted(tuple(r) for r in df.select("n", healed(df["text"], df["chars"]).alias("t")).collect())
    assert got == [(0, ""), (1, ""), (2, "short"), (3, " ".join(GIVEN)), (3, " ".join(GIVEN)), (4, " ".join(many)), (5, "a" * 20)]


def test_batches_are_as_single_lines(monkeypatch):
    """Lines of odd and plain characters in one batch; plain ones never become rows of Python."""
    pick = random.Random(5)
    kind = pa.list_(pa.struct([("x0", pa.float64()), ("x1", pa.float64()), ("size", pa.float64()), ("char", pa.string())]))
    rows = [(None, None), ("", []), ("short", chars(["short"], 1.0))]
    for _ in range(300):
        words = pick.choices([*GIVEN, "ünder", "of", "in", "\U0001d6fc"], k=pick.randint(3, 12))
        held = chars(words, pick.choice([0.2, 0.36, 1.4, 3.0]), pick.choice([0.0, 0.1, 0.4]), pick.choice([0.0, 9.0]))
        for _ in range(pick.choice([0, 0, 1, 3])):
            i = pick.randrange(len(held))
            c = held[i] or held[0] or chars(["x"], 1.0)[0]
            held[i] = pick.choice([None, {**c, "char": pick.choice([None, "", " ", "fi"])}, {**c, "x0": pick.choice([None, 1.0])}, held[i - 1]])
        rows.append(("".join(words), held))
    batch = pa.array([t for t, _ in rows], pa.string()), pa.array([c for _, c in rows], kind)
    wanted = [healed_text(t or "", c or ()) for t, c in rows]
    assert healed_batch(*batch) == wanted
    assert healed_batch(*(b.slice(7, 90) for b in batch)) == wanted[7:97]
    monkeypatch.setattr(spacing, "healed_text", None)
    assert healed_batch(pa.array(["".join(GIVEN)]), pa.array([chars(GIVEN, 1.4)], kind)) == [" ".join(GIVEN)]
