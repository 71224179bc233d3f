"""Lines, trimming, truncation, fingerprints and other text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CONTEXT = 500
SHORT_CONTEXT = 200


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", "")


def truncated(c: Column, size: int = MAX_CONTEXT) -> Column:
    """At most so many characters (characters, so none is cut)."""
    return F.substring(c, 1, size)


def lines(docs: DataFrame, content: str = "content") -> DataFrame:
    """A row per line: docs' columns but the content, line_no (from 1), line, line_before, line_after.

    Neighbours come from the same row's array: no window, no shuffle, and it works on streams."""
    rest = [c for c in docs.columns if c != content]
    parts = docs.select(*rest, F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1).alias("_lines"))
    each = parts.select(*rest, "_lines", F.posexplode("_lines").alias("_i", "line"))
    at = F.col("_i")
    return each.select(
        *rest, (at + 1).alias("line_no"), "line",
        truncated(trimmed(F.coalesce(F.get("_lines", at - 1), F.lit("")))).alias("line_before"),
        truncated(trimmed(F.coalesce(F.get("_lines", at + 1), F.lit("")))).alias("line_after"),
    )


def without_comments(c: Column) -> Column:
    """A content with comment lines blanked."""
    return F.array_join(
        F.transform(F.split(c, "\n", -1), lambda x: F.when(trimmed(x).rlike(r"^(?://|#|;|--)"), "").otherwise(x)), "\n"
    )


def redacted(c: Column) -> Column:
    """The first four characters, stars for the rest; stars alone for short values."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), n - 4)))


def cache_fingerprint(rule: Column, secret: Column, path: Column) -> Column:
    """16 bytes of SHA-256 over the three, bar-joined."""
    return F.substring(F.sha2(F.concat(rule, F.lit("|"), secret, F.lit("|"), path), 256), 1, 32)


def ignore_fingerprint(rule: Column, secret: Column, path: Column) -> Column:
    """SHA-256 over the three, colon-joined."""
    return F.sha2(F.concat(rule, F.lit(":"), secret, F.lit(":"), path), 256)


def extension(path: Column) -> Column:
    """From the last dot of the last path element; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def file_pattern(path: Column) -> Column:
    """The class of a path that verdicts are learned for."""
    low = F.lower(path)
    # the first directory of a known class decides
    found = F.regexp_extract(low, r"^(?:(?!(?:tests?|__tests__|mocks?|__mocks__|vendor|node_modules|examples?|fixtures)/)[^/]*/)*?(tests?|__tests__|mocks?|__mocks__|vendor|node_modules|examples?|fixtures)/", 1)
    ext = extension(path)
    return (
        F.when(found.isin("test", "tests", "__tests__"), "*/test/*")
        .when(found.isin("mock", "mocks", "__mocks__"), "*/mock/*")
        .when(found == "vendor", "*/vendor/*")
        .when(found == "node_modules", "*/node_modules/*")
        .when(found.isin("example", "examples", "fixtures"), "*/example/*")
        .when(ext != "", F.concat(F.lit("*"), ext))
        .otherwise("*")
    )


def base64(c: Column) -> Column:
    """Base64 in one line; Spark's own breaks it after every 76 characters."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def csv_escaped(c: Column) -> Column:
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def size_in_bytes(text: str, default: int = 5 << 20) -> int:
    """A size such as 5, 5B, 5K, 5KB, 1M or 2GB in bytes; the default for what is no size."""
    import re

    m = re.fullmatch(r"\s*([0-9]+)\s*([KMG]?)B?\s*", text.upper())
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]] if m else default
