"""Splitting of text before byte-level BPE merges."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import regex
from tokenizers import pre_tokenizers

#: The split rule of the byte-level vocabulary, with L, N and S for letters, numbers and white space.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Code points of the Unicode property White_Space, as ranges.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END_OF_TEXT = "<|endoftext|>"
_LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False)


def _ranges(kind: str, last: int) -> str:
    """Code points whose general category begins with ``kind``, as ranges of a character class."""
    out, start = [], None
    for point in range(last + 2):
        inside = point <= last and unicodedata.category(chr(point))[0] == kind
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append((start, point - 1))
            start = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def _pattern(last: int) -> re.Pattern:
    rule = SPLIT_RULE.replace("L", "{L}").replace("N", "{N}").replace("S", "{S}")
    return re.compile(rule.format(L=_ranges("L", last), N=_ranges("N", last), S=WHITE_SPACE))


def _newer_points() -> frozenset[str]:
    """Letters and numbers of the regex library that are none to the tokenizer, whose tables are older.

    Only code points that Python's own, still older tables leave unassigned can
    differ; the tokenizer's splitter is asked about each of them.
    """
    unassigned = "".join(chr(p) for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Cn")
    alone = lambda c, point: len(_LIBRARY.pre_tokenize_str(c + point)) == 2
    return frozenset(p for c, kind in (("a", r"\p{L}"), ("1", r"\p{N}")) for p in regex.findall(kind, unassigned) if alone(c, p))


@functools.cache
def _any_pattern() -> tuple[regex.Pattern, frozenset[str]]:
    rule = SPLIT_RULE.replace("L", "{L}").replace("N", "{N}").replace("S", "{S}")
    return regex.compile(rule.format(L=r"\p{L}", N=r"\p{N}", S=WHITE_SPACE)), _newer_points()


def split(text: str) -> list[str]:
    """Pieces of ``text``; merges never cross them.

    Texts of Latin-1 characters go through a small compiled class, others
    through the property tables of the regex library; the few characters that
    its tables know and the tokenizer's do not are left to the tokenizer.
    """
    if text.isascii():
        return _pattern(0x7F).findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pattern, newer = _any_pattern()
        if newer.isdisjoint(text):
            return pattern.findall(text)
        return [text[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(text)]
    return _pattern(0xFF).findall(text)
