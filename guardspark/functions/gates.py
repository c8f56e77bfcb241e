"""A look at the first character in front of a pattern.

A search tries a pattern at every place of a text.  Most places fail at the
first character, but only after word boundaries and alternatives were tried
with Unicode rules.  ``gated`` puts a plain character class in front, which
fails faster and changes nothing in what matches.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre
from re import _parser

#: More different first characters than this make no useful class.
MOST = 40
DIGIT, SPACE = r"\p{Nd}", r"\p{IsWhite_Space}"
CLASS_OF = {sre.CATEGORY_DIGIT: DIGIT, sre.CATEGORY_SPACE: SPACE}


@lru_cache(1)
def _same_letters() -> dict[str, set[str]]:
    """Characters that count as one without regard to case, letter by letter."""
    out: dict[str, set[str]] = {}
    for c in map(chr, range(0x10000)):
        up = c.upper() if len(c.upper()) == 1 else c
        out.setdefault(up.lower()[:1], set()).add(c)
    return out


def _closure(c: str) -> set[str]:
    up = c.upper() if len(c.upper()) == 1 else c
    return _same_letters().get(up.lower()[:1], set()) | {c}


def _members(items) -> set[str] | None:
    """Characters and classes of a bracket; None if it is too broad."""
    out: set[str] = set()
    for op, av in items:
        if op is sre.LITERAL:
            out |= _closure(chr(av))
        elif op is sre.RANGE and av[1] - av[0] <= MOST:
            for c in range(av[0], av[1] + 1):
                out |= _closure(chr(c))
        elif op is sre.CATEGORY and av in CLASS_OF:
            out.add(CLASS_OF[av])
        else:
            return None
    return out


def _first(items) -> tuple[set[str] | None, bool]:
    """What a sequence may begin with, and whether it may be empty."""
    out: set[str] = set()
    for op, av in items:
        empty = False
        if op is sre.LITERAL:
            new = _closure(chr(av))
        elif op is sre.IN:
            new = _members(av)
        elif op is sre.BRANCH:
            parts = [_first(p) for p in av[1]]
            new = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            empty = any(p[1] for p in parts)
        elif op is sre.SUBPATTERN:
            new, empty = _first(av[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            new, empty = _first(av[2])
            empty = empty or av[0] == 0
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            new, empty = set(), True
        else:
            new = None
        if new is None:
            return None, False
        out |= new
        if not empty:
            return out, False
    return out, True


def _tree(pattern: str):
    return _parser.parse(pattern, re.IGNORECASE)


def first_class(pattern: str) -> str | None:
    """A class of all characters that a match may begin with."""
    chars, empty = _first(_tree(pattern))
    if chars is None or empty or len([c for c in chars if ord(c[0]) < 0x250 and len(c) == 1]) > MOST:
        return None
    near = sorted(c for c in chars if len(c) == 1 and ord(c) < 0x250)
    far = sorted(ord(c) for c in chars if len(c) == 1 and ord(c) >= 0x250)
    span = rf"\x{{{far[0]:x}}}-\x{{{far[-1]:x}}}" if far else ""
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in near) + span + "".join(sorted(c for c in chars if len(c) > 1)) + "]"


@lru_cache(None)
def gated(pattern: str) -> str:
    """The pattern behind a look at the first character."""
    first = first_class(pattern)
    return f"(?=(?-iU:{first}))(?:{pattern})" if first else pattern
