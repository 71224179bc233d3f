"""Captured feeds: host names, archived URLs, GraphQL schemas, encodings, mixed input, probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions.regex import to_java
from ..functions.text import trimmed
from .detect import MIN_ENTROPY, severity_at
from .matching import line_matches
from .post import first_of
from .rule_table import RULES
from .trees import walk_json

# Fixed values.
TEXT_TYPES = (
    "text/html", "text/plain", "text/css", "text/javascript", "application/javascript", "application/json", "application/xml", "application/x-javascript",
    "text/xml", "text/json", "application/xhtml+xml", "application/rss+xml", "application/atom+xml",
)
SECRET_FIELDS = (
    "password", "secret", "token", "apiKey", "api_key", "privateKey", "private_key", "credential", "auth", "accessToken", "access_token", "refreshToken",
    "refresh_token", "secretKey", "secret_key", "encryptionKey", "encryption_key",
)
SENSITIVE_FIELDS = (
    "users", "user", "accounts", "account", "admin", "admins", "secrets", "credentials", "tokens", "apiKeys", "api_keys", "passwords", "keys", "privateKeys",
    "private_keys", "emails", "email", "phone", "phones", "billing", "payments", "transactions", "config", "settings", "environment",
)


#: Signs of the Windows variant where Latin-1 has control characters.
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _holds(c: Column, parts) -> Column:
    out, low = F.lit(False), F.lower(c)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def host_names(entries: DataFrame, domain: str) -> DataFrame:
    """(name) from (value) with names on lines: those of the domain and below, wildcards cut, each once."""
    name = F.explode(F.split("value", "\n"))
    rows = entries.select(name.alias("n")).select(F.lower(trimmed(F.col("n"))).alias("n"))
    d = domain.lower()
    rows = rows.where((F.col("n") == d) | F.col("n").endswith("." + d))
    return rows.select(F.regexp_replace("n", r"^\*\.", "").alias("name")).distinct()


def archived_urls(rows: DataFrame, domain: str) -> DataFrame:
    """(url, timestamp, status, mime) from (original, timestamp, status, mime): text pages of the domain that
    were there, each once."""
    raw = F.col("original")
    inner = F.regexp_extract(raw, r"^https?://web\.archive\.org/web/\d+/(https?://.+)", 1)
    url = F.when(inner != "", inner).when(raw.rlike("^https?://"), raw)
    text = F.lit(False)
    for t in TEXT_TYPES:
        text = text | F.lower("mime").startswith(t)
    out = rows.withColumn("url", url).where(F.col("url").isNotNull() & F.col("status").isin("200", "301", "302") & text & F.lower("url").contains(domain.lower()))
    return first_of(out.select("url", "timestamp", "status", "mime"), [F.col("url")], [F.col("timestamp")])


def graphql_types(schemas: DataFrame) -> DataFrame:
    """(path, category, source) from (path, content) introspection results: inputs that take secrets, and
    sensitive fields of the root types."""
    field = "array<struct<name:string>>"
    kind = f"struct<name:string, kind:string, fields:{field}, inputFields:{field}>"
    root = "struct<name:string>"
    s = F.from_json("content", f"struct<data:struct<__schema:struct<types:array<{kind}>, queryType:{root}, mutationType:{root}>>>")
    each = schemas.select("path", s.getField("data").getField("__schema").alias("s")).where("s.queryType is not null or s.mutationType is not null")
    types = each.select("path", F.col("s.queryType.name").alias("q"), F.col("s.mutationType.name").alias("m"), F.explode("s.types").alias("t"))
    none = F.array().cast(field)
    inputs = types.where("t.kind = 'INPUT_OBJECT'").select("path", F.col("t.name").alias("type"), F.explode(F.coalesce("t.inputFields", none)).alias("f"))
    inputs = inputs.where(_holds(F.col("f.name"), SECRET_FIELDS)).select("path", F.lit("graphql_mutation_input").alias("category"), F.concat(F.lit("graphql_input_"), "type").alias("source"))
    fields = types.select("path", "q", "m", F.col("t.name").alias("type"), F.explode(F.coalesce("t.fields", none)).alias("f")).where(_holds(F.col("f.name"), SENSITIVE_FIELDS))
    out = inputs
    for root_name, word in (("q", "query"), ("m", "mutation")):
        own = fields.where(F.col("type") == F.col(root_name))
        out = out.unionByName(own.select("path", F.lit(f"graphql_sensitive_{word}").alias("category"), F.concat(F.lit(f"graphql_{word}_"), "f.name").alias("source")))
    return out


def charset(content_type: Column, head: Column) -> Column:
    """The encoding that a header, a meta tag or the first bytes tell; empty if none does."""
    text = F.decode(F.substring(head, 1, 1024), "ISO-8859-1")
    tries = (
        F.regexp_extract(content_type, r"""(?i)charset=["']?([a-zA-Z0-9_-]+)""", 1), F.regexp_extract(text, r"""(?i)<meta[^>]+charset=["']?([a-zA-Z0-9_-]+)""", 1),
        F.regexp_extract(text, r"""(?i)<meta[^>]+content=["'][^"']*charset=([a-zA-Z0-9_-]+)""", 1),
    )
    marks = F.when(text.startswith("\xef\xbb\xbf"), "utf-8").when(text.startswith("\xfe\xff"), "utf-16be").when(text.startswith("\xff\xfe"), "utf-16le").otherwise("")
    return F.coalesce(*(F.when(t != "", F.lower(t)) for t in tries), marks)


def as_text(pages: DataFrame) -> DataFrame:
    """(path, content) from (path, content_type, content as bytes): Latin-1 and its Windows variant are
    converted, all else is read as UTF-8."""
    kind = charset(F.coalesce("content_type", F.lit("")), F.col("content"))
    latin = F.decode("content", "ISO-8859-1")
    windows = F.translate(latin, "".join(_WINDOWS), "".join(_WINDOWS.values()))
    text = F.when(kind.isin("iso-8859-1", "latin1"), latin).when(kind.isin("windows-1252", "cp1252"), windows).otherwise(F.decode("content", "UTF-8"))
    return pages.select("path", text.alias("content"))


def mixed_input(rows: DataFrame) -> DataFrame:
    """(kind, value) from lines (value): if any line is a URL only those count, else all text does."""
    lines = rows.select(trimmed(F.col("value")).alias("value")).where("value != ''")
    urls = lines.where(F.col("value").rlike("^https?://"))
    has = urls.limit(1).select(F.lit(True).alias("_has"))
    text = lines.join(F.broadcast(has), how="left").where("_has is null").select(F.lit("text").alias("kind"), "value")  # one row at most
    return urls.select(F.lit("url").alias("kind"), "value").unionByName(text)


def interesting(status: Column, size: Column, base_status: Column, base_size: Column, reflected: Column) -> Column:
    """Whether a probe's captured answer differs from the baseline."""
    room = F.greatest((base_size / 10).cast("int"), F.lit(50))
    return (status != base_status) | (F.abs(size - base_size) > room) | reflected


def json_rule_matches(docs: DataFrame) -> DataFrame:
    """(path, key_path, rule, severity, secret, entropy): rules over the string leaves of JSON contents."""
    leaves = walk_json(docs).withColumnRenamed("value", "content")
    found = line_matches(leaves, [(r.name, r.pattern) for r in RULES], whole=True)
    found = found.withColumn("severity", severity_at(RULES, F.col("ord")))
    found = found.withColumn("entropy", E.shannon(F.col("value"))).where(F.col("entropy") >= MIN_ENTROPY)
    return found.select("path", "key_path", F.concat(F.lit("json_"), "name").alias("rule"), "severity", F.col("value").alias("secret"), "entropy")


def source_map_url(content: Column) -> Column:
    """The last source map comment among a script's last five lines; empty if none."""
    tail = F.slice(F.reverse(F.split(content, "\n", -1)), 1, 5)
    hits = F.transform(tail, lambda x: F.regexp_extract(x, to_java(r"//[#@]\s*sourceMappingURL=(\S+)"), 1))
    return F.coalesce(F.get(F.filter(hits, lambda x: x != ""), 0), F.lit(""))
