"""Exact BPE encoding with reuse of words.

A byte-level BPE tokenizer of the ``tokenizers`` library cuts a text by a
pattern before it merges, so the pieces can be encoded once a worker and looked
up afterwards. Where a text holds only characters on whose classes all
regular-expression libraries agree, the pattern is applied here and pieces go
straight to the tokenizer's model. Other texts are cut between white space and
what stands before it, where no merge can cross either, and each part goes
through the whole tokenizer; texts with unusual white space are encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: White space and separators other than space and newline.
ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Separators of which it isn't agreed whether they are white space.
ODD_SPLIT = re.compile("[\x1c-\x1f\x85\u180e\ufeff]")
PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Anything but ASCII and Latin-1 letters, digits and punctuation; special tokens start with <|.
UNSAFE = re.compile("[^\n -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]|<\\|")
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d|"
#: The tokenizers' published patterns, over the characters that UNSAFE leaves.
WITH_SPACES = re.compile(rf"{ENDINGS} ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
WITHOUT_SPACES = re.compile(rf"{ENDINGS}[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: Pieces held at once by a worker, about 200 bytes each; the memory is then emptied.
MOST_PIECES = 500_000
#: Longer pieces aren't held.
LONGEST = 256


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    follow from code point 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(moved)}


class Memory(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        found = self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = found
        return found


class Encoder:
    """Whole texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)``.

    For byte-level BPE with the usual pattern, and for BPE that besides
    lower-cases, drops white space and marks word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.ends = bool(self.model.end_of_word_suffix)
        self.pattern = WITHOUT_SPACES if self.ends else WITH_SPACES
        self.pieces, self.parts = Memory(self.piece), Memory(self.whole)

    def piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        return np.asarray([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not UNSAFE.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.ends else text)))
        if (ODD_SPLIT if self.ends else ODD).search(text):
            return self.whole(text)
        return b"".join(map(self.parts.__getitem__, text.split() if self.ends else PART.findall(text)))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One a worker, so that its memory outlives a batch."""
    return Encoder(path)
