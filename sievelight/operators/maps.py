"""Source maps: files, telling names and code, positions, and scripts that lead to them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import to_java
from .detect import as_findings
from .feeds import source_map_url

# Parts of telling file names, in the order in which they are tried.
NAMES = ("password", "secret", "token", "api_key", "apikey", "private_key", "privatekey", "credentials", "auth", "access_key", "accesskey", "client_secret", "clientsecret")
# Pattern, what it tells.
CODE = (
    (r"""password\s*[=:]\s*['"]""", "hardcoded password"),
    (r"""secret\s*[=:]\s*['"]""", "hardcoded secret"),
    (r"""token\s*[=:]\s*['"]""", "hardcoded token"),
    (r"""api[_-]?key\s*[=:]\s*['"]""", "hardcoded API key"),
    (r"""bearer\s+[A-Za-z0-9\-._~+/]+=*""", "Bearer token"),
    (r"""eyJ[A-Za-z0-9\-._]+""", "JWT token"),
    (r"""AKIA[0-9A-Z]{16}""", "AWS access key"),
    (r"""ghp_[A-Za-z0-9]{36}""", "GitHub personal access token"),
    (r"""sk_live_[A-Za-z0-9]{24,}""", "Stripe live key"),
    (r"""sk_test_[A-Za-z0-9]{24,}""", "Stripe test key"),
)
_MAP = "struct<sourceRoot:string, sources:array<string>, sourcesContent:array<string>, mappings:string>"
_DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def _sources(maps: DataFrame) -> DataFrame:
    """(path, i, root, source, content): every entry of each map."""
    m = maps.select("path", F.from_json("content", _MAP).alias("m"))
    contents = F.coalesce("m.sourcesContent", F.array().cast("array<string>"))
    each = m.select("path", F.coalesce("m.sourceRoot", F.lit("")).alias("root"), F.posexplode(F.arrays_zip(F.col("m.sources").alias("source"), contents.alias("content"))).alias("i", "f"))
    return each.select("path", "i", "root", F.col("f.source").alias("source"), F.coalesce("f.content", F.lit("")).alias("content")).where("source is not null and source != ''")


def source_map_files(maps: DataFrame) -> DataFrame:
    """(path, source, full_path, content) of (path, content) source maps, the first of each source."""
    w = W.partitionBy("path", "source").orderBy("i")
    each = _sources(maps).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return each.select("path", "source", F.concat("root", "source").alias("full_path"), "content")


def source_map_secrets(maps: DataFrame) -> DataFrame:
    """(path, source, line_no, pattern, reason, content): telling file names (line 0, the first part that fits) and
    telling lines of code, whatever their letter case."""
    each = _sources(maps)
    low = F.lower("source")
    part = F.coalesce(*(F.when(low.contains(n), n) for n in NAMES))

    def cut(c: Column, n: int) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)

    named = each.select("path", "source", F.lit(0).alias("line_no"), part.alias("pattern"), cut(F.col("content"), 200).alias("content")).where("pattern is not null")
    named = named.withColumn("reason", F.concat(F.lit("filename contains '"), "pattern", F.lit("'")))
    lines = each.select("path", "source", F.posexplode(F.split("content", "\n", -1)).alias("k", "line"))
    hits = F.array(*(F.when(F.col("line").rlike(to_java("(?i)" + p)), F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("reason"))) for p, r in CODE))
    code = lines.select("path", "source", (F.col("k") + 1).alias("line_no"), F.trim(cut(F.col("line"), 100)).alias("content"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    cols = ["path", "source", "line_no", "pattern", "reason", "content"]
    return named.select(*cols).unionByName(code.select("path", "source", "line_no", "h.pattern", "h.reason", "content").select(*cols))


def inline_maps(scripts: DataFrame) -> DataFrame:
    """(path, content) of the maps that scripts (path, content) carry as a data address."""
    url = source_map_url(F.col("content"))
    found = scripts.select("path", url.alias("u")).where(F.col("u").startswith("data:") & F.col("u").contains(","))
    body = F.regexp_replace("u", "^[^,]*,", "")
    text = F.when(F.substring_index("u", ",", 1).contains("base64"), F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))
    return found.select("path", F.try_validate_utf8(text).alias("content")).where("content is not null")


def numbers(field: str) -> list[int]:
    """Numbers of a field of base-64 digits: five bits each, the sixth tells that more follow, the lowest bit of a
    number is its sign.  ValueError for other signs."""
    out, value, shift = [], 0, 0
    for c in field:
        digit = _DIGITS.get(c)
        if digit is None:
            raise ValueError(f"no base-64 digit: {c!r}")
        value |= (digit & 31) << shift
        shift += 5
        if not digit & 32:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return out


def positions(mappings: str) -> list[tuple[int, int, int, int, int]]:
    """(line, column, source, source line, source column), all from 0, of each mapping that names a source.

    Columns count on from the mapping before on the line, the other numbers from the mapping before at all.
    Fields that are malformed end their line."""
    out = []
    source = line = column = 0
    for row, fields in enumerate(mappings.split(";")):
        at = 0
        for field in filter(None, fields.split(",")):
            try:
                n = numbers(field)
            except ValueError:
                break
            at += n[0] if n else 0
            if len(n) >= 4:
                source, line, column = source + n[1], line + n[2], column + n[3]
                out.append((row, at, source, line, column))
    return out


def mappings(maps: DataFrame) -> DataFrame:
    """(path, line, col, source, source_line, source_col) of (path, content) source maps."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    m = json.loads(text)
                    names = m.get("sources") or []
                    rows += [(path, i, j, names[s], k, c) for i, j, s, k, c in positions(m.get("mappings") or "") if 0 <= s < len(names)]
                except (ValueError, TypeError, AttributeError, RecursionError):
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "line", "col", "source", "source_line", "source_col"])

    return maps.select("path", "content").mapInArrow(run, "path string, line int, col int, source string, source_line int, source_col int")


def source_lines(files: DataFrame, source: str, first: int, last: int) -> DataFrame:
    """(path, text): lines first to last (from 1) of a source of source_map_files."""
    start = max(1, first)
    part = F.slice(F.split("content", "\n", -1), F.lit(start), F.lit(max(0, last - start + 1)))
    return files.where(F.col("source") == source).select("path", F.array_join(part, "\n").alias("text"))


def referred_maps(scripts: DataFrame, captured: DataFrame) -> DataFrame:
    """(path, map_url, content): maps that captured scripts (path, content) name and that were captured too (path,
    content).  A relative address is taken from the script's folder."""
    url = source_map_url(F.col("content"))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*\z", 1)
    named = scripts.where(F.lower("path").rlike(r"\.(?:js|mjs|cjs)\z")).select("path", url.alias("u"), folder.alias("folder")).where("u != ''")
    named = named.select("path", F.when(F.col("u").rlike("^https?://"), F.col("u")).otherwise(F.concat("folder", "u")).alias("map_url"))
    return named.join(captured.select(F.col("path").alias("map_url"), "content"), "map_url").select("path", "map_url", "content")


def source_map_findings(scripts: DataFrame, captured: DataFrame, scan) -> DataFrame:
    """Findings of the maps that scripts lead to: that they are exposed, what their names and lines tell, and the
    findings of scan, a function of (path, content), in the original files."""
    maps = referred_maps(scripts, captured)
    files = source_map_files(maps.select(F.col("path"), "content"))
    count = files.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.collect_list("source").alias("all"))
    count = count.join(maps.select("path", "map_url").distinct(), "path")
    listed = F.array_sort("all")
    more = F.when(F.col("n") > 3, F.concat(F.lit("... and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    context = F.concat(F.lit("source map exposes "), F.col("n").cast("string"), F.lit(" original files: "), F.array_join(F.slice(listed, 1, 3), ", "), more)
    zero = {"col": F.lit(0), "entropy": F.lit(0.0)}
    shown = as_findings(count, 20, "source_map", 0, line_no=F.lit(1), rule=F.lit("source_map_exposed"), severity=F.lit(2), secret=F.col("map_url"), context=context, **zero)
    told = source_map_secrets(maps.select("path", "content"))
    say = F.when(F.col("content") != "", F.concat("reason", F.lit(": "), F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content")))).otherwise(F.col("reason"))
    told = as_findings(
        told, 21, "source_map", 0, path=F.col("source"), rule=F.lit("source_map_secret"), severity=F.when(F.col("line_no") > 0, 3).otherwise(2), secret=F.col("pattern"), context=say, **zero
    )
    inner = files.where("content != ''").select(F.concat("path", F.lit(" (source map: "), "source", F.lit(")")).alias("path"), "content")
    found = scan(inner)
    return shown.unionByName(told).unionByName(found.withColumn("rule", F.concat(F.lit("source_map_"), "rule")).select(*shown.columns))
