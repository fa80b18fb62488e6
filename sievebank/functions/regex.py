"""Patterns in RE2 syntax as Java patterns with the same meaning, and white space as RE2 users know it."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

_WORD = "[0-9A-Za-z_]"
#: An ASCII word boundary; Java's own \b also looks at letters beyond ASCII.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = r"[\s\p{Z}\x{85}]"


def java(pattern: str) -> str:
    """The Java form of an RE2 pattern: scripts and word boundaries are written differently."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if pattern.startswith(r"\p{Han}", k):
            out.append(r"\p{IsHan}")
            k += 7
        elif two == r"\b" and not inside:
            out.append(BOUNDARY)
            k += 2
        elif two[:1] == "\\":
            out.append(two)
            k += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            # Java would read a bracket inside a class as a nested class
            out.append("\\[" if inside and two[0] == "[" and out and _opened(pattern, k) else two[0])
            k += 1
    return "".join(out)


def _opened(pattern: str, k: int) -> bool:
    """Whether position ``k`` lies inside a class that was opened before it."""
    inside, j = False, 0
    while j < k:
        if pattern[j] == "\\":
            j += 2
            continue
        inside = pattern[j] == "[" or inside and pattern[j] != "]"
        j += 1
    return inside


def found(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, java(pattern), by)


def group(text: Column, pattern: str, k: int = 0) -> Column:
    return F.regexp_extract(text, java(pattern), k)


def trim(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def any_of(name: Column, table: tuple[tuple[str, str], ...], text: Column) -> Column:
    """The first entry of an ordered table of (value, pattern) whose pattern is found; else ``name``."""
    out = name
    for value, pattern in reversed(table):
        out = F.when(found(text, pattern), F.lit(value)).otherwise(out)
    return out


def either(*parts: pa.Array) -> pa.Array:
    return reduce(pc.or_kleene, parts)


def first_of(name: str, table: tuple[tuple[str, str], ...], text: pa.Array) -> pa.Array:
    """``any_of`` over an Arrow array, whose patterns are RE2's as they stand."""
    out = pa.repeat(name, len(text))
    for value, pattern in reversed(table):
        out = pc.if_else(pc.fill_null(pc.match_substring_regex(text, pattern), False), value, out)
    return out
