"""Ids, names and safe paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOTS = ("00_Dashboard", "01_Literature", "02_Reproduction", "03_Knowledge", "04_Weekly_Reports", "_Templates")
BLANK = " \t\n\r\x0b\x0c"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def djb2_base36(c: Column) -> Column:
    """djb2 over UTF-16 units, modulo 2^32, in base 36."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    step = lambda h, u: F.pmod(h * 33 + F.conv(u, 16, 10).cast("long"), F.lit(1 << 32))
    return F.lower(F.conv(F.aggregate(units, F.lit(5381).cast("long"), step).cast("string"), 10, 36))


def paper_id(path: Column) -> Column:
    """Base name without .pdf, 70 characters of it, and the hash of the path with forward slashes."""
    path = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.pdf$", "")
    return F.concat(F.when(base == "", "paper").otherwise(F.left(base, F.lit(70))), F.lit("_"), djb2_base36(path))


def file_key(c: Column, default: str = "progress") -> Column:
    kept = F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", ""), F.lit(128))
    return F.when(kept == "", default).otherwise(kept)


def file_name(c: Column) -> Column:
    """A name that is safe in a file system, at most 80 characters; may be empty."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/*?:"<>|]', "")
    s = F.regexp_replace(F.btrim(s, F.lit(BLANK)), r"\s+", "_")
    s = F.rtrim(F.btrim(s, F.lit("_")), F.lit(". "))
    return F.left(F.when(s.rlike(r"^\.*$"), "").otherwise(s), F.lit(80))


def in_vault(path: Column) -> Column:
    """Whether the first part of a path is a content folder."""
    return F.substring_index(path, "/", 1).isin(*ROOTS)


def safe_target(path: Column) -> Column:
    """Whether a note may be written to this relative path."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    inside = F.get(parts, F.lit(0)).isin(*ROOTS) & ~F.exists(parts, lambda p: p.isin(".", ".."))
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.contains(path, F.lit(":")) & inside & F.lower(path).endswith(".md"), F.lit(False))


def glyph_key(font: Column, cid: Column) -> Column:
    """Font name without its subset prefix, and the glyph number."""
    return F.concat(F.lit("s:"), F.substring_index(font, "+", -1), F.lit("|"), cid.cast("string"))


def hamming(a: Column, b: Column, words: int = 8) -> Column:
    """Differing bits of two hexadecimal fingerprints of `words` 32-bit words."""
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return total
