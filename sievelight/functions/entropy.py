"""Shannon entropy, alphabets and token tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import to_java

# Fixed values.
TOKEN = r"[A-Za-z0-9+/=_\-]{32,}"
EXCLUDED = r"(?i)(?:ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789\+/|MDU6[A-Za-z0-9+/=]{10,})"
SECRET_CONTEXT = r"(?i)\b(?:api[_-]?key|apikey|secret|secret[_-]?key|password|passwd|pwd|token|bearer|auth(?:orization)?|credential|private[_-]?key|access[_-]?key|client[_-]?(?:id|secret)|aws|gcp|azure|s3|encryption[_-]?key|signing[_-]?key|jwt|oauth|ssh[_-]?key)\b"
CONTEXT_KEYWORDS = ("secret", "token", "apikey", "api_key", "auth", "bearer", "password", "credential", "private", "secret_key", "access_key")
MEDIA_PREFIXES = (
    "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "52494646", "3C3F786D6C", "3C737667", "00000100",
    "49492A00", "4D4D002A", "424D", "774F4646", "774F4632", "00010000", "4F54544F",
)


def shannon(c: Column) -> Column:
    """Bits per character, three places; characters are summed in order, so the sum is the same each time."""
    n = F.length(c).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        p = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double") / n
        return acc - p * F.log2(p)

    signs = F.array_sort(F.array_distinct(F.split(c, "")))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.round(F.aggregate(signs, F.lit(0.0), add), 3))


def alphabet(c: Column) -> Column:
    url = c.rlike("[-_]") & c.rlike(r"^[0-9A-Za-z_-]+\z")
    return (
        F.when(url & c.contains("-") & c.contains("_"), "jwt")
        .when(url, "base64url")
        .when(c.rlike(r"^[0-9a-fA-F]+\z") & c.rlike("[A-F]"), "upperhex")
        .when(c.rlike(r"^[0-9a-fA-F]+\z"), "hex")
        .when(c.rlike(r"^[0-9A-Za-z]*=+\z"), "base64")
        .otherwise("unknown")
    )


def likely_secret(c: Column, min_len: int, min_entropy: float) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "['\"`)]+\\z", ""), "^['\"`(]+", "")
    kinds = sum(
        (s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[+/=_\-@$!%^&*()]")), F.lit(0)
    )
    return (F.length(s) >= min_len) & ~s.rlike(r"^[0-9]*\z") & (kinds >= 3) & (shannon(s) >= min_entropy)


def filtered(c: Column, allowed: str) -> Column:
    """Entropy, or 0 where a character is not in the class allowed."""
    return F.when(c.rlike(rf"^[{allowed}]*\z"), shannon(c)).otherwise(F.lit(0.0))


def by_alphabet(c: Column) -> Column:
    a = alphabet(c)
    return (
        F.when(a.isin("hex", "upperhex"), filtered(c, "0-9a-fA-F"))
        .when(a.isin("base64url", "jwt"), filtered(c, "A-Za-z0-9_-"))
        .when(a == "base64", filtered(c, "A-Za-z0-9+/="))
        .otherwise(shannon(c))
    )


def token_match(c: Column) -> Column:
    a = alphabet(c)
    floor = F.when(a.isin("hex", "upperhex"), 3.0).otherwise(4.0)
    good = F.when(a == "unknown", likely_secret(c, 32, 4.5)).otherwise(by_alphabet(c) >= floor)
    return ~c.rlike(to_java(EXCLUDED)) & (F.length(c) >= 32) & good


def media(c: Column) -> Column:
    """Whether the first 20 characters decode to the start of an image or font."""
    padded = F.concat(c, F.when(F.length(c) % 4 == 2, "==").when(F.length(c) % 4 == 3, "=").otherwise(""))
    head = F.substring(padded, 1, 20)
    head = F.when(F.length(head) % 4 == 0, head).otherwise(F.expr("null"))
    raw = F.hex(F.try_to_binary(F.when(head.rlike(r"^[A-Za-z0-9+/]*=*\z"), head), F.lit("base64")))
    hit = F.lit(False)
    for p in MEDIA_PREFIXES:
        one = raw.startswith(p)
        hit = hit | (one & (F.substring(raw, 17, 8) == "57454250") if p == "52494646" else one)
    return (F.length(c) >= 8) & F.coalesce((F.length(raw) >= 8) & hit, F.lit(False))


def secret_context(c: Column) -> Column:
    return c.rlike(to_java(SECRET_CONTEXT))


def context_keyword(c: Column) -> Column:
    low, hit = F.lower(c), F.lit(False)
    for k in CONTEXT_KEYWORDS:
        hit = hit | low.contains(k)
    return hit
