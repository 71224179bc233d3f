"""Decoders: encoded text inside lines, decoded in layers and scanned again.

Byte decoding with strict padding, inflation and escapes have no built-in expressions with these semantics,
so the decoders run in Arrow batches; lines without a candidate are dropped before that."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions.text import lines
from .detect import MIN_ENTROPY, as_findings, severity_at, severity_of
from .matching import line_matches
from .rule_table import RULES, Rule

MAX_DEPTH = 3
#: A text of readable characters alone.
PLAIN = r"^[\x20-\x7E\t\n\r]+\z"
# Fixed values.
_BASE64 = re.compile(r"\b[A-Za-z0-9+/]{32,}\b", re.A)
_HEX = re.compile(r"\b(?:[0-9a-fA-F]{2}){10,}\b", re.A)
_URL64 = re.compile(r"\b[A-Za-z0-9\-_]{32,}={0,2}", re.A)
_TWICE = re.compile(r"\b[A-Za-z0-9+/]{32,}={0,2}\b", re.A)
_JWT = re.compile(r"\b[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b", re.A)
_CHARS = re.compile(r"String\.fromCharCode[\t\n\f\r ]*\(([^)]+)\)")
_MAY_HOLD = r"[A-Za-z0-9+/_-]{32}|(?:[0-9a-fA-F]{2}){10}|\\u[0-9a-fA-F]{4}|%[0-9a-fA-F]{2}|\.[A-Za-z0-9_-]+\.|String\.fromCharCode"


def _bytes(s: str, url: bool = False) -> bytes | None:
    s += "=" * (-len(s) % 4)
    if s.endswith("==="):
        return None
    try:
        return base64.b64decode(s, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _readable(data: bytes) -> bool:
    good = sum(0x20 <= b <= 0x7E or b in (9, 10, 13) for b in data)
    return good >= len(data) // 2


def _text(data: bytes | None) -> list[str]:
    return [data.decode("utf-8", "replace")] if data is not None and _readable(data) else []


def _plain64(s: str) -> list[str]:
    return [t for m in _BASE64.findall(s) for t in _text(_bytes(m))]


def _from_hex(s: str) -> list[str]:
    out = []
    for m in _HEX.findall(s):
        if m.lower() != m and m.upper() != m:
            continue
        for t in _text(bytes.fromhex(m)):
            if t.rstrip("x").lower().strip() not in ("", "hex"):
                out.append(t)
    return out


def _escapes(s: str) -> list[str]:
    out = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else "�", s)
    return [out] if out != s else []


def _percent(s: str) -> list[str]:
    """Each byte is one sign, so bytes from 0x80 on become Latin-1 signs."""
    out = re.sub(r"%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), s)
    return [out] if out != s else []


def _token_body(s: str) -> list[str]:
    return [t for m in _JWT.findall(s) for t in _text(_bytes(m.split(".")[1], True))]


def _safe64(s: str) -> list[str]:
    return [t for m in _URL64.findall(s) if "-" in m or "_" in m for t in _text(_bytes(m, True))]


def _double64(s: str) -> list[str]:
    return [t for m in _TWICE.findall(s) for t in _text(_bytes(m)) if _TWICE.search(t)]


#: Larger contents of compressed data are not unpacked at all, so that a small file cannot fill a task's memory.
MAX_INFLATED = 256 << 20


def inflated(data: bytes, limit: int = MAX_INFLATED) -> bytes | None:
    """Contents of gzip or zlib data; None for other data and for contents over the limit."""
    if data[:2] != b"\x1f\x8b" and data[:1] != b"\x78":
        return None
    unpack = zlib.decompressobj(47)
    try:
        out = unpack.decompress(data, limit)
    except zlib.error:
        return None
    return None if unpack.unconsumed_tail else out


def _gzip64(s: str) -> list[str]:
    out = []
    for m in re.findall(r"\b[A-Za-z0-9+/]{64,}={0,2}", s, re.A):
        data = _bytes(m)
        data = inflated(data) if data else None
        if data:
            out.append(data.decode("utf-8", "replace"))
    return out


def _char_codes(s: str) -> list[str]:
    out = []
    for args in _CHARS.findall(s):
        codes = [int(x) for x in (p.strip() for p in args.split(",")) if re.fullmatch(r"[+-]?[0-9]+", x)]
        t = "".join("�" if 0xD800 <= c < 0xE000 else chr(c) for c in codes if 0 <= c <= 0x10FFFF)
        if t:
            out.append(t)
    return out


DECODERS: dict[str, Callable[[str], list[str]]] = {
    "base64": _plain64, "hex": _from_hex, "unicode": _escapes, "url": _percent, "base64url": _safe64, "jwt": _token_body,
    "doublebase64": _double64, "gzip": _gzip64, "charcode": _char_codes,
}


def layers(text: str, names: Sequence[str], depth: int = MAX_DEPTH) -> list[tuple[str, str, int]]:
    """(tag, decoded text, layer), each layer decoded again up to depth."""
    out, todo = [], [(text, 1)]
    while todo:
        s, level = todo.pop()
        for name in names:
            for t in DECODERS[name](s):
                out.append((name, t, level))
                if level < depth:
                    todo.append((t, level + 1))
    return out


def decoded(docs: DataFrame, names: Sequence[str] = ("base64", "hex", "unicode", "url"), depth: int = MAX_DEPTH) -> DataFrame:
    """(path, line_no, tag, text, layer) of every decoded piece."""
    each = lines(docs.select("path", "content")).where(F.col("line").rlike(_MAY_HOLD)).select("path", "line_no", "line")
    names = tuple(names)

    def run(batches):
        for b in batches:
            rows = [(p, n, *x) for p, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in layers(s, names, depth)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "line_no", "tag", "text", "layer"])

    return each.mapInArrow(run, "path string, line_no int, tag string, text string, layer int")


def scan_decoded(
    docs: DataFrame, names: Sequence[str] = ("base64", "hex", "unicode", "url"), rules: Sequence[Rule] = RULES, min_severity: int = 0, depth: int = MAX_DEPTH, plain: bool = False,
) -> DataFrame:
    """Rules over decoded pieces, without the context gate; rule names carry the decoder's tag.

    Half of a piece's bytes must be readable; all of its characters if plain."""
    rules = [r for r in rules if severity_of(r.severity) >= min_severity]
    pieces = decoded(docs, names, depth)
    if plain:
        pieces = pieces.where(F.col("text").rlike(PLAIN))
    pieces = pieces.withColumnRenamed("text", "content").withColumnRenamed("line_no", "at")
    found = line_matches(pieces, [(r.name, r.pattern) for r in rules], whole=True)
    found = found.withColumn("severity", severity_at(rules, F.col("ord")))
    found = found.withColumn("entropy", E.shannon(F.col("value"))).where(F.col("entropy") >= MIN_ENTROPY)
    context = F.concat(F.col("tag"), F.lit(" decoded: "), F.substring("line", 1, 500))
    return as_findings(
        found, 7, "decoded_regex", 70, line_no=F.col("at"), col=F.lit(0), rule=F.concat_ws("_", "tag", "name"), secret=F.col("value"), context=context
    )
