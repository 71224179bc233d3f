"""Patterns are written in RE2 syntax; here they are made to mean the same in Python and Java.

What differs: ``\\s`` (no vertical tab in RE2), ``\\b`` (ASCII words in RE2), ``$`` (only at the very end), ``.`` and
line ends, letter case beyond ASCII.  Python needs the ASCII flag, ``\\s`` and ``$`` rewritten; Java also
needs ``\\b`` as look-arounds and Unix line ends.
"""

from __future__ import annotations

import re
from functools import lru_cache

_SPACE = r"\t\n\f\r "
_JAVA_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _rewritten(pattern: str, edge: str, end: str, java: bool) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{_SPACE}]")
            elif two == r"\b" and not inside:
                out.append(edge)
            elif two == r"\z":
                out.append(end)
            elif two == r"\_":
                out.append("_")
            else:
                out.append(two)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or java and c == "&":
                c = "\\" + c
        elif c == "[":
            inside = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        elif c == "$":
            c = end
        out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    flags = "(?d)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?diu)", pattern[4:]
    return flags + _rewritten(pattern, _JAVA_EDGE, r"\z", True)


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern[str]:
    """The pattern for Python's engine."""
    flags = re.A
    if pattern.startswith("(?i)"):
        flags, pattern = flags | re.I, pattern[4:]
    return re.compile(_rewritten(pattern, r"\b", r"\Z", False), flags)
