"""Many patterns over many lines, in Arrow batches.

Spark's own regular expressions take about ten times as long for some two hundred patterns (see the README's
figures), and their dialect differs.  Nearly all contents match nothing, so what a match must hold is derived from each
pattern: one of some literals, and maybe a long run of token characters.  Two passes of Arrow's RE2 kernel over a
batch drop the contents that hold neither; in the others a pattern is tried only if its literals are there, and only
on the lines that have one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.regex import compiled

#: Characters of tokens, and how many in a row are a long run; words of prose are shorter.
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-./+=")
RUN = 20
_LONG = "[A-Za-z0-9_./+=-]{20}"


class Guard(NamedTuple):
    """What each match of a pattern holds: one of the literals (none known: empty), compared without letter case
    if fold; and so many token characters in a row."""

    literals: tuple[str, ...]
    fold: bool
    run: int


def _class(items) -> frozenset[str] | None:
    """ASCII characters of a character class; None if it may hold others."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        elif op is C.CATEGORY and arg is C.CATEGORY_DIGIT:
            out.update("0123456789")
        elif op is C.CATEGORY and arg is C.CATEGORY_WORD:
            out.update(c for c in _TOKEN if c.isalnum() or c == "_")
        else:
            return None
    return frozenset(out)


def _held(seq) -> tuple[list[str] | None, int]:
    """Literals of which a match of the parsed sequence has one, the longest ones found; and the longest run."""
    best: list[str] | None = None
    letters: list[str] = []
    run = longest = 0

    def consider(found: list[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in [*seq, (None, None)]:
        if op is C.LITERAL:
            letters.append(chr(arg))
            run = run + 1 if chr(arg) in _TOKEN else 0
            longest = max(longest, run)
            continue
        consider(["".join(letters)] if letters else None)
        letters = []
        if op is C.IN:
            own = _class(arg)
            run = run + 1 if own and own <= _TOKEN else 0
        elif op is C.SUBPATTERN:
            found, inner = _held(arg[3])
            consider(found)
            longest, run = max(longest, inner), 0
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            found, inner = _held(arg[2])
            consider(found)
            one = list(arg[2])
            own = _class(one[0][1]) if len(one) == 1 and one[0][0] is C.IN else None
            if own and own <= _TOKEN:
                run += arg[0]
                longest = max(longest, run)
                if arg[1] != arg[0]:
                    continue
            else:
                longest, run = max(longest, inner), 0
        elif op is C.BRANCH:
            parts = [_held(x) for x in arg[1]]
            if all(p for p, _ in parts):
                consider([x for p, _ in parts for x in p])
            longest, run = max(longest, min(n for _, n in parts)), 0
        elif op is not C.AT:
            run = 0
        longest = max(longest, run)
    return best, longest


@lru_cache(maxsize=4096)
def guard(pattern: str) -> Guard:
    own = compiled(pattern)
    literals, run = _held(_parser.parse(own.pattern, own.flags & ~re.UNICODE))
    fold = bool(own.flags & re.IGNORECASE)
    return Guard(tuple(dict.fromkeys(x.lower() if fold else x for x in literals or ())), fold, run)


@lru_cache(maxsize=4096)
def edges(pattern: str) -> tuple[str, str]:
    """The literals that every match of a pattern begins and ends with (empty: none known, or letter case open)."""
    own = compiled(pattern)
    if own.flags & re.IGNORECASE:
        return "", ""
    seq = list(_parser.parse(own.pattern, own.flags & ~re.UNICODE))

    def ahead(items) -> str:
        out = []
        for op, arg in items:
            if op is not C.LITERAL:
                break
            out.append(chr(arg))
        return "".join(out)

    return ahead(seq), ahead(reversed(seq))[::-1]


class Finder:
    """The patterns that may match a text."""

    def __init__(self, patterns: Sequence[str]) -> None:
        self.patterns = [compiled(p) for p in patterns]
        self.guards = [guard(p) for p in patterns]
        hints = {x for g in self.guards if g.run < RUN for x in g.literals}
        self.always = any(g.run < RUN and not g.literals for g in self.guards)
        self.hint = "(?i)" + "|".join(sorted(map(re.escape, hints))) if hints else None

    def worth(self, texts: pa.Array) -> list[tuple[int, bool]]:
        """Indices of texts that may match something, and whether they hold a long run."""
        long = pc.fill_null(pc.match_substring_regex(texts, _LONG), False)
        some = long
        if self.always:
            some = pc.is_valid(texts)
        elif self.hint:
            some = pc.or_(long, pc.fill_null(pc.match_substring_regex(texts, self.hint), False))
        return [(i, long[i].as_py()) for i in pc.indices_nonzero(some).to_pylist()]

    def candidates(self, text: str, low: str, among, long: bool = True) -> list[int]:
        out = []
        for k in among:
            g = self.guards[k]
            if g.run >= RUN and not long:
                continue
            own = low if g.fold else text
            if not g.literals or any(x in own for x in g.literals):
                out.append(k)
        return out


def line_matches(
    docs: DataFrame, patterns: Sequence[tuple[str, str]], group: int = 0, first_only: bool = False, content: str = "content", whole: bool = False, shown: int | None = None,
) -> DataFrame:
    """docs' columns but the content, then line_no, line, ord (of the pattern), name, col (bytes before the
    match), value: the matches of each (name, pattern) in each line (or, if whole, in the content as
    one line); group 0 is the whole match.  Of a line at most `shown` characters are given back; None: all."""
    rest = [f for f in docs.schema.fields if f.name != content]
    names = [f.name for f in rest]
    patterns = list(patterns)

    def run(batches):
        finder = Finder([p for _, p in patterns])
        for b in batches:
            texts = b.column(len(names))
            rows, no, line_, ord_, col, val = [], [], [], [], [], []
            for i, long in finder.worth(texts):
                text = texts[i].as_py()
                low = text.lower()
                among = finder.candidates(text, low, range(len(patterns)), long)
                if not among:
                    continue
                for n, line in enumerate([text] if whole else text.split("\n"), 1):
                    for k in among if whole else finder.candidates(line, line.lower(), among):
                        seen = before = 0
                        for m in finder.patterns[k].finditer(line):
                            if m.group(group) is None:
                                continue
                            before += len(line[seen : m.start(group)].encode())
                            seen = m.start(group)
                            rows.append(i)
                            no.append(n)
                            line_.append(line[:shown])
                            ord_.append(k)
                            col.append(before)
                            val.append(m.group(group))
                            if first_only:
                                break
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(j).take(at) for j in range(len(names))), pa.array(no, pa.int32()), pa.array(line_, pa.string()),
                    pa.array(ord_, pa.int32()), pa.array([patterns[k][0] for k in ord_], pa.string()), pa.array(col, pa.int32()), pa.array(val, pa.string()),
                ],
                [*names, "line_no", "line", "ord", "name", "col", "value"],
            )

    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in (
        ("line_no", T.IntegerType()), ("line", T.StringType()), ("ord", T.IntegerType()), ("name", T.StringType()), ("col", T.IntegerType()), ("value", T.StringType())
    ))])
    return docs.select(*names, content).mapInArrow(run, schema)
