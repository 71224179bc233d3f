"""JSON trees and script text: walks, telling keys, joined and propagated string constants."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions.regex import to_java
from ..functions.text import SHORT_CONTEXT, extension
from .detect import MIN_ENTROPY, as_findings, severity_at, severity_of
from .matching import line_matches
from .rule_table import RULES, Rule

# Fixed values.
SECRET_KEY = r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|access[_-]?token|auth[_-]?token|auth[_-]?key|client[_-]?secret|client[_-]?id|private[_-]?key|ssh[_-]?key|encryption[_-]?key|signing[_-]?key|bearer|credential|refresh[_-]?token|session[_-]?key|secret[_-]?key|master[_-]?key)$"


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def deep_leaves(text: str) -> list[tuple[str, str]]:
    """Key paths and values of the string leaves of JSON of any depth; ValueError for other texts."""
    out: list[tuple[str, str]] = []
    stack: list[list] = []  # open containers: closing sign, and the path's part below it
    at = 0

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    def member(i: int) -> int:
        """Reads on to the value of the innermost container's next member."""
        top = stack[-1]
        if top[0] == "]":
            top[1] = 0 if top[1] is None else top[1] + 1
            return i
        if text[i : i + 1] != '"':
            raise ValueError("a key is missing")
        top[1], i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return skip(i + 1)

    def path() -> str:
        parts = []
        for close, part in stack:
            parts.append(f"[{part}]" if close == "]" else f".{part}" if parts else part)
        return "".join(parts)

    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            stack.append(["}" if c == "{" else "]", None])
            at = skip(at + 1)
            if text[at : at + 1] != stack[-1][0]:
                at = member(at)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
            if value:
                out.append((path(), value))
            at = skip(at)
        else:
            m = _PLAIN.match(text, at)
            if not m:
                raise ValueError("a value is missing")
            at = skip(m.end())
        while stack and text[at : at + 1] == stack[-1][0]:
            stack.pop()
            at = skip(at + 1)
        if not stack:
            if at != len(text):
                raise ValueError("text after the value")
            return out
        if text[at : at + 1] != ",":
            raise ValueError("a comma is missing")
        at = member(skip(at + 1))


def _leaves(text: str) -> list[tuple[str, str]]:
    try:
        todo = [("", json.loads(text))]
    except RecursionError:
        return deep_leaves(text)
    out = []
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{at}[{i}]", x) for i, x in enumerate(v)]
        elif isinstance(v, str) and v:
            out.append((at, v))
    return out


def walk_json(docs: DataFrame) -> DataFrame:
    """(path, key_path, value): string leaves of each JSON content; contents that are not JSON give none."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *x) for x in _leaves(text)]
                except (ValueError, TypeError):
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "key_path", "value"])

    return docs.select("path", "content").mapInArrow(run, "path string, key_path string, value string")


def last_key(key_path: Column) -> Column:
    dot = F.regexp_extract(key_path, r"\.([^.]*)$", 1)
    return F.when(key_path.contains("."), dot).when(key_path.contains("["), F.regexp_extract(key_path, r"(\[[^\[]*)$", 1)).otherwise(key_path)


def json_secrets(docs: DataFrame) -> DataFrame:
    """(path, key_path, rule, secret, entropy) of values under telling keys."""
    leaves = walk_json(docs).withColumn("key", last_key(F.col("key_path"))).withColumn("entropy", E.shannon(F.col("value")))
    good = F.col("key").rlike(to_java(SECRET_KEY)) & (F.length("value") >= 8) & ~F.col("value").rlike(r"^[0-9]+\z") & (F.col("entropy") >= 3.0)
    return leaves.where(good).select("path", "key_path", F.concat(F.lit("json_"), "key").alias("rule"), F.col("value").alias("secret"), "entropy")


# ---- script text ---------------------------------------------------------------------------------------

# Repeated groups are possessive: Java's engine calls itself for each turn of others, so a long text would end its thread.
_LITERAL = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
MIN_LENGTH = 20
#: Texts with these are code or data that literals were found in by chance.
_STRUCTURE = r"[{}\[\]:,]"
_DECLARED = r"\b(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=\s*"


def _plain(literal: Column) -> Column:
    return F.substring(literal, F.lit(2), F.length(literal) - 2)


def _literals(c: Column) -> Column:
    """Contents of a text's string literals; escapes stay as they are written."""
    return F.transform(F.regexp_extract_all(c, F.lit(_LITERAL), F.lit(0)), _plain)


def _last_entries(names: Column, values: Column) -> Column:
    """A map of names to values; of several values of a name the last one."""
    entries = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["v"].alias("v")))
    ordered = F.array_sort(entries)
    last = F.filter(ordered, lambda x, i: ~x["n"].eqNullSafe(F.get(ordered, i + 1)["n"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["n"], x["v"])))


def _declared(pattern: str) -> tuple[Column, Column]:
    return tuple(F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in (1, 2))


def _constants() -> Column:
    names, values = _declared(rf"{_DECLARED}({_LITERAL})\s*(?:;|,|\n|\z)")
    return _last_entries(names, F.transform(values, _plain))


def _arrays() -> Column:
    """Names and elements of arrays of literals."""
    names, values = _declared(rf"{_DECLARED}\[([^\]]+)\]")
    both = F.filter(F.arrays_zip(names.alias("n"), F.transform(values, _literals).alias("e")), lambda x: F.size(x["e"]) > 0)
    return _last_entries(F.transform(both, lambda x: x["n"]), F.transform(both, lambda x: x["e"]))


def constants(docs: DataFrame) -> DataFrame:
    """(path, name, value): string constants of each document; of several declarations the last one."""
    return docs.select("path", F.explode(_constants()).alias("name", "value"))


def arrays(docs: DataFrame) -> DataFrame:
    """(path, name, elements): arrays of string literals of each document; of several declarations the last one."""
    return docs.select("path", F.explode(_arrays()).alias("name", "elements"))


_JOIN = rf"\[\s*{_LITERAL}(?:\s*,\s*{_LITERAL})++\s*,?\s*\]\s*\.\s*join\s*\(\s*{_LITERAL}\s*\)"
_NAME = r"\b[A-Za-z_$][\w$]*"


def _joined_parts(x: Column) -> Column:
    """The literals of an expression but the last, with the last between them."""
    parts = _literals(x)
    return F.call_function("array_join", F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1))


def _sum_of(x: Column) -> Column:
    """The constants that a sum names, put together; null if one is unknown."""
    values = F.transform(F.split(x, r"\s*\+\s*"), lambda n: F.col("_constants")[n])
    return F.when(~F.exists(values, lambda v: v.isNull()), F.array_join(values, ""))


#: Kind, a sign that its lines have, pattern, texts of a match.
_PARTS = (
    ("concat", "+", rf"{_LITERAL}(?:\s*\+\s*{_LITERAL})++", lambda x: F.array(F.array_join(_literals(x), ""))),
    ("join", "join", _JOIN, lambda x: F.array(_joined_parts(x))),
    ("var", "+", rf"{_NAME}(?:\s*\+\s*[A-Za-z_$][\w$]*)++", lambda x: F.array(_sum_of(x))),
    ("ternary", "?", rf"\?\s*{_LITERAL}\s*:\s*{_LITERAL}", lambda x: _literals(x)),
    ("array", "[", rf"{_NAME}\[\d{{1,9}}\]", lambda x: F.array(F.get(F.col("_arrays")[F.substring_index(x, "[", 1)], F.regexp_extract(x, r"\[(\d+)\]", 1).cast("int")))),
    ("template", "`", r"`[^`$]*`", lambda x: F.array(_plain(x))),
)


def rebuilt(docs: DataFrame, kinds: Sequence[str] = tuple(p[0] for p in _PARTS)) -> DataFrame:
    """(path, line_no, kind, expr, text): what script text puts together from parts, from 20 bytes on.

    Constants and arrays are those of the document: they stand in its own row, so nothing is joined, and a
    document is read once."""
    own = docs.where(F.col("content").rlike("[\"'`]")).select("path", "content", _constants().alias("_constants"), _arrays().alias("_arrays"))
    lines = F.split("content", "\n", -1)

    def found(kind: str, mark: str, pattern: str, texts) -> Column:
        def of(line: Column, i: Column) -> Column:
            each = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda x: F.transform(
                texts(x), lambda t: F.struct((i + 1).alias("line_no"), F.lit(kind).alias("kind"), x.alias("expr"), t.alias("text"))
            ))
            good = F.filter(F.flatten(each), lambda r: F.octet_length(r["text"]) >= MIN_LENGTH)
            return F.when(line.contains(mark), good).otherwise(F.filter(good, lambda r: F.lit(False)))

        return F.flatten(F.transform(lines, of))

    every = F.concat(*(found(*p) for p in _PARTS if p[0] in kinds))
    out = own.select("path", F.explode(every).alias("r")).select("path", "r.*")
    return out.where((F.col("kind") != "concat") | ~F.col("text").rlike(_STRUCTURE))


def concatenated(docs: DataFrame) -> DataFrame:
    """(path, line_no, text): chains of literals around +, put together."""
    return rebuilt(docs, ("concat",)).select("path", "line_no", "text")


def joined_arrays(docs: DataFrame) -> DataFrame:
    """(path, line_no, text): ["a", "b"].join("s") put together, for arrays of two literals or more."""
    return rebuilt(docs, ("join",)).select("path", "line_no", "text")


def propagated(docs: DataFrame) -> DataFrame:
    """(path, line_no, expr, text): sums of names that are all constants of the document, put together."""
    return rebuilt(docs, ("var",)).select("path", "line_no", "expr", "text")


def accessed(docs: DataFrame) -> DataFrame:
    """(path, line_no, expr, text): name[i] of an array of literals of the document."""
    return rebuilt(docs, ("array",)).select("path", "line_no", "expr", "text")


def templates(docs: DataFrame) -> DataFrame:
    """(path, line_no, text): backtick strings without substitutions."""
    return rebuilt(docs, ("template",)).select("path", "line_no", "text")


def branches(docs: DataFrame) -> DataFrame:
    """(path, line_no, text): both literals of a choice."""
    return rebuilt(docs, ("ternary",)).select("path", "line_no", "text")


def scan_rebuilt(docs: DataFrame, rules: Sequence[Rule] = RULES, min_severity: int = 0, longest: int | None = 200) -> DataFrame:
    """Findings of the rules in rebuilt texts (their first part; whole texts if longest is None), without the context gate."""
    rules = [r for r in rules if severity_of(r.severity) >= min_severity]
    text = F.col("text") if longest is None else F.substring("text", 1, longest)
    pieces = rebuilt(docs.select("path", "content")).select("path", F.col("line_no").alias("at"), "kind", text.alias("content"))
    found = line_matches(pieces, [(r.name, r.pattern) for r in rules], whole=True, shown=SHORT_CONTEXT)
    found = found.withColumn("severity", severity_at(rules, F.col("ord")))
    found = found.withColumn("entropy", E.shannon(F.col("value"))).where(F.col("entropy") >= MIN_ENTROPY)
    return as_findings(
        found, 10, "script", 0, line_no=F.col("at"), col=F.lit(0), rule=F.concat_ws("_", F.lit("reconstructed"), "kind", "name"), secret=F.col("value"),
        context=F.concat(F.lit("js reconstructed: "), "line"),
    )


def json_findings(docs: DataFrame, rules: Sequence[Rule] = RULES, min_severity: int = 0) -> DataFrame:
    """Findings in JSON files: values under telling keys, and the rules over all string leaves."""
    own = docs.where(F.lower(extension(F.col("path"))) == ".json").select("path", "content")
    context = F.concat(F.lit("json key: "), "key_path")
    keys = as_findings(json_secrets(own), 11, "json_key", 0, line_no=F.lit(0), col=F.lit(0), severity=F.lit(2), context=context)
    rules = [r for r in rules if severity_of(r.severity) >= min_severity]
    found = line_matches(walk_json(own).withColumnRenamed("value", "content"), [(r.name, r.pattern) for r in rules], whole=True)
    found = found.withColumn("severity", severity_at(rules, F.col("ord")))
    found = found.withColumn("entropy", E.shannon(F.col("value"))).where(F.col("entropy") >= MIN_ENTROPY)
    return keys.unionByName(as_findings(found, 12, "json_rule", 0, line_no=F.lit(0), col=F.lit(0), rule=F.concat(F.lit("json_"), "name"), secret=F.col("value"), context=context))


# ---- specifications ------------------------------------------------------------------------------------

# Operations of a path.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def _from_yaml(specs: DataFrame) -> DataFrame:
    """(path, content) with YAML contents as JSON; what is no mapping is left out."""

    def run(batches):
        import yaml

        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tree = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if isinstance(tree, dict):
                    rows.append((path, json.dumps(tree, default=str)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "content"])

    return specs.select("path", "content").mapInArrow(run, "path string, content string")


def openapi_endpoints(specs: DataFrame) -> DataFrame:
    """(path, endpoint, title, version) of (path, content) specifications, the path being their address.

    An endpoint is address, base path and path with the method; if no path has a known method, the paths alone
    are endpoints.  Contents in JSON are read as they are, others as YAML (with PyYAML installed)."""
    schema = "struct<basePath:string, info:struct<title:string,version:string>, paths:map<string,map<string,string>>>"
    kinds = specs.select("path", "content", F.from_json("content", schema).alias("s"))
    has = F.size(F.coalesce(F.col("s.paths"), F.create_map().cast("map<string,map<string,string>>"))) > 0
    read = kinds.where(has)
    try:
        import yaml  # noqa: F401
    except ImportError:
        pass
    else:
        other = _from_yaml(kinds.where(~has & F.col("content").contains("paths")).select("path", "content"))
        read = read.unionByName(other.select("path", "content", F.from_json("content", schema).alias("s")).where(has))

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, "^/+|/+$", "")

    base = F.when(F.coalesce("s.basePath", F.lit("")) != "", F.concat(F.lit("/"), bare(F.col("s.basePath")))).otherwise("")
    address = F.concat(F.regexp_replace("path", "/+$", ""), base)
    each = read.select("path", address.alias("address"), F.coalesce("s.info.title", F.lit("")).alias("title"), F.coalesce("s.info.version", F.lit("")).alias("version"), F.map_entries("s.paths").alias("routes"))
    known = F.flatten(F.transform("routes", lambda r: F.transform(
        F.filter(F.transform(F.map_keys(r["value"]), F.upper), lambda m: m.isin(*METHODS)),
        lambda m: F.concat(F.lit("/"), F.regexp_replace(r["key"], "^/+", ""), F.lit(" ["), m, F.lit("]")),
    )))
    alone = F.transform("routes", lambda r: F.concat(F.lit("/"), F.regexp_replace(r["key"], "^/+", "")))
    each = each.select("path", "address", "title", "version", F.explode(F.when(F.size(known) > 0, known).otherwise(alone)).alias("route"))
    return each.select("path", F.concat("address", "route").alias("endpoint"), "title", "version")
