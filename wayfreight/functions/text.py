"""Text functions on columns. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() treats as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def contains_any(text: Column, literals: tuple[str, ...]) -> Column:
    """True where ``text`` holds at least one of the literals. NULL text stays NULL."""
    return reduce(lambda a, b: a | b, [text.contains(s) for s in literals])


def swap(text: Column, old: str, new: str) -> Column:
    """Replace every occurrence of a literal."""
    return F.replace(text, F.lit(old), F.lit(new))


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal, from the bytes that taking them out would save.

    No regex engine and no array of matches: one literal replace and two stored lengths.
    """
    saved = F.octet_length(text) - F.octet_length(swap(text, literal, ""))
    return F.call_function("div", saved, F.lit(len(literal.encode()))).cast("bigint")


def unix_lines(text: Column) -> Column:
    """Turn CRLF and lone CR into LF; text without any CR is passed through untouched."""
    return F.when(text.contains("\r"), swap(swap(text, "\r\n", "\n"), "\r", "\n")).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines; stops reading at the n-th line end."""
    return F.substring_index(text, "\n", n)
