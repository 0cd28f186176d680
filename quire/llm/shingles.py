"""Word shingles of whole texts as 64-bit hashes, many texts at once in numpy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A-Z
lower-cased. A text's set holds the hashes of its distinct runs of five words;
a text of fewer words has its whole sequence as one; a text without words has
the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
U = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, *range(9, 14)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE, STEPS = U(0x9E3779B97F4A7C15 | 1), [U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Arrays take about 50 bytes for each byte of a batch.
BATCH_BYTES = 1_000_000
_POWERS = np.cumprod(np.full(4096, BASE, U))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ h >> U(33)
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ h >> U(33)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(n + n // 4, BASE, U))
    return _POWERS


def batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts in UTF-8) of about a MB each; a longer text stands alone."""
    first, out, size = 0, [], 0
    for i, t in enumerate(texts):
        data = (t.as_py() or "").encode()
        if out and size + len(data) > BATCH_BYTES:
            yield first, out
            first, out, size = i, [], 0
        out.append(data)
        size += len(data)
    if out:
        yield first, out


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all sets, and the bounds: text i has hashes[bounds[i]:bounds[i + 1]]."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts).translate(LOWER) + b"\n", np.uint8)
    gap = SEPARATORS[data]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    from_ = starts[0]
    word = np.repeat(starts, np.diff(np.append(starts, len(data))))
    at = np.arange(from_, len(data)) - word
    kept = ~gap[from_:]
    at[~kept] = 0
    letters = (data[from_:].astype(U) + U(1)) * _powers(int(at.max()) + 1)[at]
    letters[~kept] = 0
    words = mix(np.add.reduceat(letters, starts - from_))
    of = np.searchsorted(text_ends, starts, side="right")
    rolled = np.zeros(max(0, len(words) - WIDTH + 1), U)
    for j in range(WIDTH):
        rolled += words[j : j + len(rolled)] * STEPS[j]
    whole = of[: len(rolled)] == of[WIDTH - 1 :][: len(rolled)]
    hashes, owner = [mix(rolled[whole])], [of[: len(rolled)][whole]]
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < WIDTH)):
        own = words[first[i] : first[i] + count[i]]
        hashes.append(mix(np.sum(own * np.array(STEPS[: len(own)], U), dtype=U, keepdims=True) + U(len(own))))
        owner.append(np.array([i]))
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(o, minlength=n)))).astype(np.int64)
