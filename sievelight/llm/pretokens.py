"""Splitting text before byte-level merges, a batch of texts at a time, and encoding each distinct piece once.

The split equals ``public_tokenizers.PATTERN``:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Piece starts follow from the class of a code point and its neighbours, so whole arrays are split at once:

* a letter, number or other sign starts a piece where its class changes, unless a single space stands
  before it (the space is then the start);
* the last white space before a sign is a start, as is the first one of each run;
* an apostrophe that is a start takes s, t, m, d, re, ve or ll with it; what follows starts anew.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Code points of texts that are taken together.
SLICE = 1 << 20
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    if "class" not in _tables:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = _OTHER
        _tables["class"] = table
    return _tables["class"]


def split(codes: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Indices of piece starts in the code points of texts that begin at doc_at."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[codes]
    space = kind == _SPACE
    first = np.zeros(n + 1, dtype=bool)
    first[doc_at] = True
    first, last = first[:n], np.append(first[1:n], True)
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = codes[:-1] == 0x20
    start &= ~after_blank | space
    before_sign = np.zeros(n, dtype=bool)
    before_sign[:-1] = ~space[1:]
    start |= space & before_sign & ~last
    start |= first
    mark = np.flatnonzero((codes == 0x27) & start)
    if len(mark):
        end = np.append(doc_at[1:], n)[np.searchsorted(doc_at, mark, side="right") - 1]
        padded = np.append(codes, [0, 0]).astype(np.int64)
        one, two = padded[mark + 1], padded[mark + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & (mark + 1 < end)
        pair = one * 0x110000 + two
        double = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & (mark + 2 < end)
        for which, width in ((single, 2), (double & ~single, 3)):
            at, stop = mark[which], end[which]
            for k in range(1, width):
                start[at + k] = False
            at, stop = at + width, stop
            at = at[at < stop]
            # a blank run's own starts are set above; any other sign starts a piece here
            start[at] = True
    return np.flatnonzero(start)


def _unlike(codes: np.ndarray, start: np.ndarray, size: np.ndarray, others: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether the codes from start on differ from the others from other on, piece by piece."""
    odd = size != other_size
    same = np.flatnonzero(~odd)
    for i in range(0, len(same), 1 << 16):  # in parts, so that indices stay small
        part = same[i : i + (1 << 16)]
        n = size[part]
        at = np.cumsum(n) - n
        step = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(at, n).astype(np.int32)
        unequal = codes[np.repeat(start[part], n) + step] != others[np.repeat(other[part], n) + step]
        if unequal.any():
            odd[part] = np.add.reduceat(unequal, at) > 0
    return odd


def _grown(x: np.ndarray, need: int) -> np.ndarray:
    return x if need <= len(x) else np.resize(x, max(need, 2 * len(x)))


class PieceCoder:
    """ids of texts, from ids of their pieces.  encode gets distinct pieces and returns a list of ids each.

    Equal pieces are found by a 64-bit hash of random values for each code point, random for each process; then
    every piece is compared, code point by code point, with the one that stands for its hash in the batch, and
    that one with the one in memory.  What differs is looked up by itself.  At most ``held`` pieces are remembered."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], held: int = 500_000) -> None:
        self.encode, self.held = encode, held
        rng = np.random.default_rng()
        self.mix = rng.integers(0, 1 << 63, size=0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(int(rng.integers(1 << 40, 1 << 60)) * 8 + 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}  # hash to number
        self.odd: dict[str, int] = {}  # pieces whose hash another one has
        self.known = self.used = self.signs = 0
        self.count, self.first = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.begin, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.ids, self.codes = np.zeros(4096, dtype=np.int32), np.zeros(4096, dtype=np.uint32)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; those of a very long piece are not kept."""
        if len(self.power) >= n:
            return self.power, self.back
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, self.base, dtype=np.uint64)) * self.inverse
            back = np.cumprod(np.full(n, self.inverse, dtype=np.uint64)) * self.base
        if n <= 2 * SLICE:
            self.power, self.back = power, back
        return power, back

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces."""
        lists = self.encode(pieces)
        n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(n.sum()))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        k, have = self.known, self.known + len(pieces)
        self.count, self.first, self.begin, self.size = (_grown(x, have) for x in (self.count, self.first, self.begin, self.size))
        self.ids, self.codes = _grown(self.ids, self.used + len(flat)), _grown(self.codes, self.signs + len(codes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.codes[self.signs : self.signs + len(codes)] = codes
        self.count[k:have], self.size[k:have] = n, size
        self.first[k:have] = self.used + np.cumsum(n) - n
        self.begin[k:have] = self.signs + np.cumsum(size) - size
        self.known, self.used, self.signs = have, self.used + len(flat), self.signs + len(codes)
        return np.arange(k, have)

    def _by_name(self, piece: str) -> int:
        if piece not in self.odd:
            self.odd[piece] = int(self._learn([piece])[0])
        return self.odd[piece]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the piece in this coder's memory for every piece of the texts, and where each text's
        pieces begin (with the end as the last value)."""
        if self.known > self.held:
            self.clear()
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        start = split(codes, np.unique(begins[lengths > 0]))
        stop = np.append(start[1:], len(codes)).astype(np.int64)
        bounds = np.append(np.searchsorted(start, begins), len(start))
        if not len(start):
            return np.zeros(0, dtype=np.int64), bounds
        power, back = self._powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(self.mix[codes] * power[: len(codes)], out=total[1:])
            h = (total[stop] - total[start]) * back[start]
        del total
        size = stop - start
        which, seen = pd.factorize(h)
        where = np.full(len(seen), -1, dtype=np.int64)
        where[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the first piece of each hash
        keys = seen.tolist()
        number = np.array(list(map(self.at.get, keys, repeat(-1))), dtype=np.int64)
        old = np.flatnonzero(number >= 0)
        bad = old[_unlike(codes, start[where[old]], size[where[old]], self.codes, self.begin[number[old]], self.size[number[old]])]
        new = np.flatnonzero(number < 0)
        if len(new):
            a, b = start[where[new]].tolist(), stop[where[new]].tolist()
            number[new] = self._learn([joined[i:j] for i, j in zip(a, b, strict=True)])
            self.at.update(zip([keys[i] for i in new.tolist()], number[new].tolist(), strict=True))
        for i in bad.tolist():
            number[i] = self._by_name(joined[start[where[i]] : stop[where[i]]])
        out = number[which]
        model = where[which]
        other = np.flatnonzero((model != np.arange(len(model))))
        other = other[_unlike(codes, start[other], size[other], codes, start[model[other]], size[model[other]])]
        for i in other.tolist():
            out[i] = self._by_name(joined[start[i] : stop[i]])
        return out, bounds

    def spread(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces in turn, and how many each has."""
        n = self.count[pieces]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.first[pieces] - before, n) + np.arange(int(n.sum()))], n


def slices(batches, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes of text in a column, a longer text alone: what Python
    holds at once is bounded by a piece.  Freed memory goes back to the system when the batches end, as workers
    outlive their tasks."""
    try:
        for b in batches:
            bytes_ = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
            at = total = 0
            for i, n in enumerate(bytes_.tolist()):
                if i > at and total + n > size:
                    yield b.slice(at, i - at)
                    at, total = i, 0
                total += n
            if at < b.num_rows:
                yield b.slice(at)
    finally:
        pa.default_memory_pool().release_unused()
        _trim()


def _trim() -> None:
    """Asks the C library to return free memory; other libraries than glibc have no such call."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def chunks(texts: list[str | None], chars: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive texts of about so many code points together; a longer text is alone."""
    at, own, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if own and size + len(t) > chars:
            yield at, i, own
            at, own, size = i, [], 0
        own.append(t)
        size += len(t)
    if own:
        yield at, len(texts), own


def cut(text: str, chars: int = SLICE) -> list[str]:
    """The text in parts of about so many code points.  A part ends where white space follows another sign: there a
    piece always ends, and what follows is split as if it stood alone.  A run without such a place stays whole."""
    out, at = [], 0
    while len(text) - at > chars:
        m = _GAP.search(text, at + chars)
        if not m:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


_GAP = regex.compile(r"\S(?=\s)")


def encoded(coder: PieceCoder, texts: list[str | None], chars: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids of consecutive texts in turn and how many each has, some chars code points together."""
    for _, _, part in chunks(texts, chars):
        if len(part) == 1 and len(part[0]) > chars:
            ids = [coder.spread(coder.pieces([p])[0])[0] for p in cut(part[0], chars)]
            yield np.concatenate(ids), np.array([sum(map(len, ids))])
            continue
        pieces, bounds = coder.pieces(part)
        ids, n = coder.spread(pieces)
        to = np.concatenate([[0], np.cumsum(n)])[bounds]
        yield ids, np.diff(to)
