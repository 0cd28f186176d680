"""Spaces of lines whose characters stand at exact places but have no spaces between words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English words, by which a cut is judged.
COMMON = (
    "a an the and or but of to in for with on at by from as is are was were be been being it its this that these those there here not no if do does did "
    "can could may might must shall should will would has have had also which who whom whose when where why how all any each both more most other some "
    "such only own same so too very one two via per etc vs we our they them their he she they i you he me my mine ours yours theirs "
    "we show shown thus hence therefore however moreover furthermore whereas"
).split()
KNOWN = frozenset(COMMON)


def hits(words: list[str]) -> int:
    return sum(w.strip(".,;:'()[]").lower() in KNOWN for w in words)


def healed_text(text: str, chars: Iterable[Mapping]) -> str:
    words = text.split()
    most = max(map(len, words), default=0)
    placed = sorted(((c["x0"] or 0.0, c["x1"] or 0.0, c["size"] or 0.0, c["char"]) for c in chars if c is not None and c["char"]), key=lambda c: c[0])
    if len(text) < 16 or len(placed) < 12 or most < 14 or sum(ord(c) < 128 for c in text) < 0.9 * len(text):
        return text
    once = list({(round(c[0], 2), round(c[1], 2), c[3]): c for c in reversed(placed)}.values())[::-1]
    bare, known, best = "".join(words), hits(words), None
    for given in [once, placed] if len(once) < len(placed) else [placed]:
        if sorted(c[2] for c in given if c[2])[-1:] in ([], [0.0]) or "".join(re.sub(r"\s+", "", c[3]) for c in given) != bare:
            continue
        apart = [0.0, *(b[0] - a[1] for a, b in zip(given, given[1:]))]
        for gap in sorted({round(g, 3) for g in apart if g > 0.05}):
            cut = "".join((" " if d > max(0.35, gap * 0.9) else "") + c[3] for d, c in zip(apart, given)).split()
            found, longest = hits(cut), max(map(len, cut))
            if longest < most and longest <= 26 and len(cut) >= len(words) + 2 and len(bare) >= 3 * len(cut) and found >= 2 and found > known and (best is None or (found, -len(cut)) > best[0]):
                best = (found, -len(cut)), " ".join(cut)
    return text if best is None else best[1]


#: Places at least so far apart are different after rounding.
APART = 0.02


def _cut(text: str, words: list[str], line: str, apart: np.ndarray) -> str:
    """As `healed_text` of a line of single characters at places of their own, in
    order: line joins them, apart has the distance before each."""
    most, known, best, tried = max(map(len, words)), hits(words), None, set()
    for gap in sorted({round(g, 3) for g in apart[apart > 0.05].tolist()}):
        at = np.flatnonzero(apart > max(0.35, gap * 0.9)).tolist()
        if len(at) in tried:  # wider gaps cut at fewer places, so these are the same
            continue
        tried.add(len(at))
        cut = [line[a:b] for a, b in zip([0, *at], [*at, len(line)])]
        longest = max(map(len, cut))
        if longest < most and longest <= 26 and len(cut) >= len(words) + 2 and len(line) >= 3 * len(cut):
            found = hits(cut)
            if found >= 2 and found > known and (best is None or (found, -len(cut)) > best[0]):
                best = (found, -len(cut)), " ".join(cut)
    return text if best is None else best[1]


def healed_batch(texts: pa.Array, held: pa.Array) -> list[str]:
    """`healed_text` of each row. Places are compared for all lines of a batch at
    once; lines with doubled, blank, missing or unordered characters go one by one."""
    given = held.flatten()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
    x0, x1, size = (pc.fill_null(pc.struct_field(given, c), 0.0).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "size"))
    char = pc.struct_field(given, "char")
    single = pc.fill_null(pc.equal(pc.utf8_length(char), 1), False).to_numpy(zero_copy_only=False) & pc.is_valid(given).to_numpy(zero_copy_only=False)
    single &= ~pc.fill_null(pc.utf8_is_space(char), True).to_numpy(zero_copy_only=False)
    char = pc.fill_null(char, "").cast(pa.string())
    apart = np.zeros(len(x0))
    apart[1:] = x0[1:] - x1[:-1]
    plain = single & np.isfinite(x0) & np.isfinite(x1)
    step = np.ones(len(x0), bool)
    step[1:] = x0[1:] - x0[:-1] > APART
    starts = ends[:-1]
    step[starts[starts < len(x0)]] = True
    apart[starts[starts < len(x0)]] = 0.0
    odd = np.append(0, np.cumsum(~(plain & step)))
    sized = np.append(0, np.cumsum(size != 0.0))
    at, raw = np.frombuffer(char.buffers()[1], np.int32, len(char) + 1, char.offset * 4) if len(char) else np.zeros(1, np.int32), char.buffers()[2]
    out = []
    for i, text in enumerate(texts.to_pylist()):
        text, a, b = text or "", ends[i], ends[i + 1]
        words = text.split()
        if len(text) < 16 or b - a < 12 or max(map(len, words), default=0) < 14:
            out.append(text)  # as it would be with any characters
        elif odd[b] > odd[a]:
            out.append(healed_text(text, held[i].as_py()))
        else:
            line = raw[at[a] : at[b]].to_pybytes().decode()
            changes = sized[b] > sized[a] and line == "".join(words) and (text.isascii() or sum(ord(c) < 128 for c in text) >= 0.9 * len(text))
            out.append(_cut(text, words, line, apart[a:b]) if changes else text)
    return out


def healed(text: Column, chars: Column) -> Column:
    """The text of a line with spaces where its characters (array of x0, x1, size,
    char) stand apart, if that makes better English of words run together.

    Each distance between neighbours is tried as the least width of a space; the
    one with the most common words is taken, of equal ones that with the fewest
    words, then the smallest. Only spaces change. Lines of fewer than 16
    characters, with little ASCII or without a long word stay, as do those that no
    cut improves by two words or more. A null text is empty; null or empty
    characters count for nothing; doubled ones (same place, same character) count
    once, if the text has them once. A cut depends on the whole line, so it is made
    by an Arrow function over lines.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array, held: pa.Array) -> pa.Array:
        return pa.array(healed_batch(texts, held), pa.string())

    return run(text, chars)
