"""Text semantics shared by every feature.

The corpus rules are written in terms of Unicode whitespace, Unicode word
characters and lines that end at ``\\n`` only.  Java's ``\\s``, ``\\w``, ``.``
and ``trim`` all mean something narrower, so the exact classes are spelled out
here once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters of the corpus rules.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Characters that count as digits without being decimal digits
# (superscripts, circled and parenthesised digits).
DIGITS = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}"
    r"\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}"
    r"\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}"
    r"\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}"
    r"\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def words(c: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(c, F.lit(f"{WORD}+"), F.lit(0))


def n_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def n_char(c: Column, ch: str) -> Column:
    """Occurrences of one character, without building a match list."""
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("double")


def n_in_class(c: Column, excluded: str) -> Column:
    """Characters left after deleting every character of the class ``excluded``."""
    return F.length(F.regexp_replace(c, excluded, "")).cast("double")
