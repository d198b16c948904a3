"""Column expressions on text that every part of the engine shares; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that take no room on the page, as ranges.
INVISIBLE_RANGES = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0)]
#: White space, line breaks included.
SPACE_RANGES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def char_class(ranges: list[tuple[int, int]]) -> str:
    """A regular-expression class that Java's and Python's engines both read."""
    return "[" + "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


INVISIBLE, SPACES = char_class(INVISIBLE_RANGES), char_class(SPACE_RANGES)
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def words(text: Column) -> Column:
    """Non-empty pieces between white space, Unicode white space included; NULL gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def letters_and_digits(text: Column) -> Column:
    """Lower-case letters and digits; width, case, invisible and all other characters left out."""
    return F.regexp_replace(F.lower(half_width(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]", "")
