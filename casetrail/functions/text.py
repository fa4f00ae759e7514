"""Small string helpers used by all other column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: all characters that count as white space, as ``(?U)[\s\x1c-\x1f]`` does.
WHITE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


# Anything but white space.
NOT_WHITE = r"[^\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What a text has that may hold white space other than blanks and ends of lines.
NOT_PLAIN = r"[^\n -~]"


def strip(value: Column) -> Column:
    """Remove leading and trailing white space of any kind, no-break spaces included."""
    return F.trim(value, F.lit(WHITE))


def strip_chars(value: Column, chars: str) -> Column:
    return F.trim(value, F.lit(chars))


def null_if_empty(value: Column) -> Column:
    """Null for the empty text. ``value`` is evaluated once, so calls can be nested freely."""
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


def blank_to_null(value: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return null_if_empty(strip(value))


def extract(value: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or where the group is empty."""
    return null_if_empty(F.regexp_extract(value, pattern, group))


def fields(value: Column, pattern: str, groups: int) -> Column:
    """All groups of a matching text as an array, with one regex run."""
    marks = "\u0001".join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(value, pattern, marks), "\u0001", -1)


def contains_any(value: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(value, F.lit(word))
    return found


def squeeze(value: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "")


def count_chars(value: Column, char_class: str) -> Column:
    """How many characters of ``value`` belong to a regex class such as ``\\p{L}``."""
    return F.length(F.regexp_replace(value, f"[^{char_class}]", ""))
