"""Text rules with Python string semantics, as JVM column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# Java's \s under (?U) lacks the four separators that Python counts as whitespace.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

# Category "Other" without the control characters that count as whitespace.
NON_PRINTABLE = r"[\p{C}&&[^\t-\r\x1c-\x1f\x85]]"


def strip(text: Column) -> Column:
    """str.strip(): looks at both ends only, so long texts cost nothing extra."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Python `re` pattern for the JVM, with Unicode whitespace and folding."""
    flags = "(?iU)" if ignore_case else "(?U)"
    return flags + pattern.replace(r"\s", SPACE).replace(r"\S", NON_SPACE)


def printable_share(text: Column) -> Column:
    """Share of characters that are printable or whitespace; NULL for empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, f"{NON_PRINTABLE}+", "")), F.length(text))


def replace_each(
    text: Column,
    found: Column,
    search: Callable[[Column], Column],
    replacement: Callable[[Column], Column],
) -> Column:
    """Replace the items of `found` literally and everywhere, one after the other.

    Not regexp_replace: an item may be part of another item.
    """
    return F.aggregate(
        found, text, lambda current, item: F.replace(current, search(item), replacement(item))
    )
