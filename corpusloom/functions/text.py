"""String, list and key columns. All functions are Column -> Column and run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E and their ASCII partners, by rule.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "

#: Words and signs that stand for "no value".
PLACEHOLDERS = ("", "-", "--", "?", "0", "n/a", "na", "n.a.", "n.a", "nan", "nil", "none", "null", "not available", "unknown", "undefined", "missing", "tbd")


#: Blanks of any kind, line breaks, zero-width marks and the BOM.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF)))


def strip(c: Column) -> Column:
    """``c`` without white space of any kind, zero-width marks or BOMs at its ends."""
    return F.btrim(c, F.lit(_BLANKS))


def narrow(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic blank replaced by plain ones."""
    return F.translate(c, _WIDE, _NARROW)


def match_key(c: Column) -> Column:
    """Upper-case key without blanks or punctuation, equal for all widths and cases; null stays null."""
    return F.upper(F.regexp_replace(narrow(c), r"[^\p{L}\p{M}\p{N}]+", ""))


def is_placeholder(c: Column) -> Column:
    """True for null, blank and values that only say that there is no value (brackets around them too)."""
    bare = F.lower(F.regexp_replace(strip(narrow(c)), r"^[\[(<{]+|[\])>}]+$", ""))
    return F.coalesce(bare.isin(*PLACEHOLDERS) | ~bare.rlike(r"[\p{L}\p{N}]"), F.lit(True))


def usable_key(c: Column) -> Column:
    """match_key, or null where ``c`` names nothing (blank, placeholder, only zeros)."""
    key = match_key(c)
    return F.when(~is_placeholder(c) & ~key.rlike("^0*$") & ~key.isin("NONE", "NULL", "NA", "NAN", "UNKNOWN", "NOTAVAILABLE"), key)


def clean_number(c: Column) -> Column:
    """Identifier without blanks, hyphens, slashes, commas and dots, upper-cased; null stays null."""
    return F.upper(F.regexp_replace(c, r"[\s\-/,.]", ""))


def split_list(c: Column, sep: str = ";;") -> Column:
    """Filled elements of a delimited cell in order, trimmed; null and blank cells give an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip)
    return F.filter(parts, lambda x: x != "")


def split_codes(c: Column, sep: str = ";;") -> Column:
    """Distinct, sorted, trimmed elements of a delimited cell; a ``['a', 'b']`` literal is accepted too."""
    bare = F.when(c.rlike(r"^\s*\[\s*['\"]"), F.regexp_replace(F.regexp_replace(c, r"^\s*\[|\]\s*$|['\"]", ""), r"\s*,\s*", sep)).otherwise(c)
    return F.array_sort(F.array_distinct(split_list(bare, sep)))


def last_filled(c: Column, sep: str = ";;") -> Column:
    """Last filled element of a delimited cell, or null."""
    return F.try_element_at(split_list(c, sep), F.lit(-1))


def first_filled(c: Column, sep: str = ";;") -> Column:
    """First filled element of a delimited cell, or null."""
    return F.get(split_list(c, sep), 0)


def any_prefix(codes: Column, prefixes: tuple[str, ...]) -> Column:
    """True if any array element starts with any prefix (case-sensitive); null arrays give false."""
    if not prefixes:
        return F.lit(False)
    hit = lambda x: F.greatest(*[F.startswith(x, F.lit(p)) for p in prefixes]) if len(prefixes) > 1 else F.startswith(x, F.lit(prefixes[0]))
    return F.coalesce(F.exists(codes, hit), F.lit(False))


def code_slices(codes: Column, length: int) -> Column:
    """Distinct sorted heads of ``length`` characters; shorter codes are left out."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(codes, lambda x: F.length(x) >= length), lambda x: F.substring(x, 1, length))))


def title_and_body(title: Column, body: Column) -> Column:
    """``title. body`` with nulls as empty text, stripped."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(body, F.lit(""))))


def contains(c: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware regex search; null is no match."""
    return F.coalesce(c, F.lit("")).rlike(f"(?iU){pattern}")


#: What may part the words of a phrase, and what may end an abbreviation.
_GAP, _PLURAL = r"[\s\-]+", "s?"


def _literal(word: str) -> str:
    """``word`` as a pattern that matches nothing but itself."""
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in word)


def _edge(char: str) -> str:
    """A word boundary beside a word character, else no word character beside it."""
    return r"\b" if char.isalnum() or char == "_" else ""


def phrase_pattern(abbreviations: tuple[str, ...] = (), phrases: tuple[str, ...] = ()) -> str:
    """Pattern for a category: abbreviations match whole words with an optional plural s, phrase words may be
    joined by blanks or hyphens and the last one may go on. Signs in either stand for themselves."""
    short = (f"{_edge(a[0])}{_literal(a)}{_PLURAL}" + (r"\b" if _edge(a[-1]) else r"(?!\w)") for a in abbreviations)
    long = (_edge(p.split()[0][0]) + _GAP.join(map(_literal, p.split())) + r"\w*" for p in phrases)
    return "(?:" + "|".join([*short, *long]) + ")"
