"""What script text gives away: requests, environment variables, internal addresses, telling files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.text import extension, trimmed, truncated
from .detect import as_findings
from .matching import line_matches
from .post import first_of
from .surface import origin

# Kind, pattern (group 1 is the value).
FACTS = (
    ("env", r"process\.env\.([A-Z_][A-Z0-9_]*)"),
    ("env_meta", r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)"),
    ("env", r"process\.env\['([A-Z_][A-Z0-9_]*)'\]"),
    ("env", r'process\.env\["([A-Z_][A-Z0-9_]*)"\]'),
    ("endpoint", r"import\s*\(\s*'([^']+)'\s*\)"),
    ("endpoint", r'import\s*\(\s*"([^"]+)"\s*\)'),
    ("endpoint", r"import\s*\(\s*`([^`]+)`\s*\)"),
    ("module", r"require\s*\(\s*'([^']+)'\s*\)"),
    ("module", r'require\s*\(\s*"([^"]+)"\s*\)'),
    ("leaked_comment", r"""//\s*(https?://[^\s'"]+)"""),
    ("todo", r"(?i)(?:TODO|FIXME|HACK|XXX|TEMP)\s*[:;]\s*(.+)"),
    ("endpoint", r"""(?i)(?:baseURL|apiURL|api_url|endpoint|baseUrl|host|server|origin)\s*[:=]\s*['"]([^'"]+)['"]"""),
    ("config_secret", r"""(?i)(?:apiKey|api_key|token|secret|password|auth)\s*[:=]\s*['"]([^'"]+)['"]"""),
    ("internal_url", r"""(?i)(?:internal|private|corp|intranet|staging|dev|sandbox|test)\s*[:=]\s*['"]([^'"]+)['"]"""),
    ("internal_url", r"((?:localhost|127\.0\.0\.1|0\.0\.0\.0):\d+)"),
    ("sensitive_file", r"""['"]([^'"]*(?:\.env|\.key|\.pem|\.cert|\.p12|\.pfx|\.jks|\.keystore|credentials?\.json|secrets?\.json|service[_-]?account)[^'"]*)['"]"""),
    ("debug", r"""(?i)['"]([^'"]*(?:debug|trace|profile|inspect|devtools|console)[^'"]*)['"]"""),
    ("source_map", r"""(?:sourceMappingURL|sourceURL)\s*[:=]\s*['"]?([^'"\s]+\.map)['"]?"""),
    ("endpoint", r"""['"]([^'"]*/(?:v\d+|api/v\d+|version/\d+)[^'"]*)['"]"""),
    ("route", r"""(?i)(?:route|path|redirect|forward)\s*[:=]\s*['"]([^'"]+/[^'"]+)['"]"""),
    ("base64", r"""['"`]([A-Za-z0-9+/]{40,}={0,2})['"`]"""),
    ("chunk", r"""import\s*\(\s*['"]([^'"]*chunk[^'"]*\.js)['"]\s*\)"""),
)
# Marks of a bundler on a line, without which a chunk does not count.
BUNDLERS = (
    r"(?:webpackChunk|webpackJsonp|__webpack_require__|webpack_modules)\b",
    r"(?:(?:__vite_|vite客户端|vite/client)[\w.]*)",
)
PLACEHOLDERS = ("xxx", "your_key_here", "CHANGE_ME")
_TELLING = ("key", "token", "secret", "password")
_DECODED = ("http", "key", "token", "secret")
_LEAKING = ("api", "key", "token", "secret", "internal")
#: Kinds whose every occurrence is a secret of its own; of the others each value counts once a document.
SECRETS = ("todo", "base64", "config_secret")
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")


def _any_of(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def decoded64(c: Column) -> Column:
    """The text of a well-formed base64 value, padded or not; null for others and for what is no UTF-8."""
    bare = F.regexp_replace(c, "=+\\z", "")
    rest = F.length(bare) % 4
    good = (rest != 1) & ((F.length(c) == F.length(bare)) | (F.length(c) % 4 == 0))
    raw = F.try_to_binary(F.when(good, F.rpad(bare, (F.floor((F.length(bare) + 3) / 4) * 4).cast("int"), F.lit("="))), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(path, kind, value, decoded, line_no, line, ord, col): every fact where it stands."""
    found = line_matches(docs.select("path", "content"), FACTS, group=1).withColumn("value", trimmed(F.col("value"))).withColumnRenamed("name", "kind").where("value != ''")
    v, k = F.col("value"), F.col("kind")
    found = found.withColumn("decoded", F.when(k == "base64", decoded64(v)))
    bundled = F.lit(False)
    for p in BUNDLERS:
        bundled = bundled | F.col("line").rlike(to_java(p))
    return found.where(
        F.when(k == "module", v.contains("/") | v.startswith(".")).when(k == "todo", _any_of(v, _TELLING))
        .when(k == "config_secret", (F.octet_length("value") > 5) & ~v.isin(*PLACEHOLDERS))
        .when(k == "route", v.startswith("/") & ~v.startswith("//")).when(k == "base64", F.coalesce(_any_of(F.col("decoded"), _DECODED), F.lit(False)))
        .when(k == "chunk", bundled).otherwise(True)
    )


def facts(docs: DataFrame) -> DataFrame:
    """(path, kind, value, line_no): each value of a kind where a document first has it."""
    k = F.col("kind")
    value = F.when(k == "env_meta", F.concat(F.lit("IMPORT_META_"), "value")).otherwise(F.col("value"))
    kind = F.when(k == "env_meta", "env").when(k.isin("module", "route"), "endpoint").when(k == "todo", "comment_leak").otherwise(k)
    found = occurrences(docs).withColumn("value", value).withColumn("kind", kind).drop("decoded", "line")
    return first_of(found, [F.col("path"), F.col("kind"), F.col("value")], [F.col("line_no"), F.col("ord"), F.col("col")]).select("path", "kind", "value", "line_no")


def is_script(path: Column) -> Column:
    return F.lower(extension(path)).isin(*EXTENSIONS)


def script_findings(docs: DataFrame) -> DataFrame:
    """Findings from the facts of script files: secrets where they stand, other telling values once a file."""
    own = docs.where(is_script(F.col("path")))
    base, k, v = F.element_at(F.split("path", "/"), -1), F.col("kind"), F.col("value")
    kinds = {
        "internal_url": ("internal_url", 2, "internal/hidden URL found in "), "debug": ("debug_artifact", 1, "debug/development artifact in "),
        "sensitive_file": ("sensitive_file_ref", 2, "sensitive file reference in "), "leaked_comment": ("comment_leak", 2, "URL found in comment in "),
    }
    secret = k.isin(*SECRETS)
    each = occurrences(own).where(secret | k.isin(*kinds) & ((k != "leaked_comment") | _any_of(v, _LEAKING)))
    w = W.partitionBy("path", "kind", "value").orderBy("line_no", "ord", "col")
    each = each.withColumn("_n", F.row_number().over(w)).where(secret | (F.col("_n") == 1)).drop("col")
    rule = F.concat(F.lit("js_secret_"), F.when(k == "todo", "comment_leak").otherwise(k))
    sev = F.when(k == "todo", 2).otherwise(3)
    context = F.when(k == "todo", F.lit("TODO/FIXME comment")).when(k == "base64", F.concat(F.lit("base64 decoded: "), "decoded")).otherwise(trimmed(F.col("line")))
    for name, (r, n, text) in kinds.items():
        rule, sev, context = F.when(k == name, r).otherwise(rule), F.when(k == name, n).otherwise(sev), F.when(k == name, F.concat(F.lit(text), base)).otherwise(context)
    return as_findings(
        each, 8, "script", 0, line_no=F.when(secret, F.col("line_no")).otherwise(1), col=F.lit(0), rule=rule, severity=sev, secret=v, context=truncated(context), entropy=F.lit(0.0)
    )


# How, pattern, group of the method (0: by default), default method, group of the endpoint.
REQUESTS = (
    ("fetch", r"""fetch\s*\(\s*(['"`])(https?://[^'"`]+)['"`]""", 0, "GET", 2),
    ("axios", r"""axios\.(get|post|put|delete|patch|head|options)\s*\(\s*(['"`])(https?://[^'"`]+)['"`]""", 1, "", 3),
    ("xhr", r"""\.open\s*\(\s*(['"`])(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['"`]\s*,\s*(['"`])([^'"`]+)['"`]""", 2, "", 4),
    ("apollo", r"""(?:uri|endpoint|url)\s*[:=]\s*(['"`])(https?://[^'"`]*(?:graphql|gql)[^'"`]*)['"`]""", 0, "POST", 2),
    ("auth", r"""['"`]Authorization['"`]\s*[:=]\s*(['"`])(Bearer\s+(\S+)|Basic\s+(\S+)|(\S+))['"`]""", 0, "", 0),
)
METHOD = r"""method\s*:\s*(['"`])(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['"`]"""
HEADERS = r"""headers\s*:\s*\{([^}]+)\}"""
HEADER = r"""(['"`])([^'"`]+)['"`]\s*:\s*(['"`])([^'"`]+)['"`]"""


def _last_of(entries: Column) -> Column:
    """Entries (k, v) without those that a later one of the same key replaces."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))


def requests(docs: DataFrame) -> DataFrame:
    """(path, endpoint, method, domain, headers, api_keys, line_no): calls in script text, each endpoint and method
    once a document.  An Authorization header gives its bearer token or decoded basic pair as a key; on a line without a
    call it counts alone, with an empty endpoint."""
    found = line_matches(docs.select("path", "content"), [(n, p) for n, p, *_ in REQUESTS])
    endpoint, method = F.lit(""), F.lit("")
    for name, p, m, default, e in REQUESTS:
        mine = F.col("name") == name
        if e:
            endpoint = F.when(mine, F.regexp_extract("value", to_java(p), e)).otherwise(endpoint)
        method = F.when(mine, F.upper(F.regexp_extract("value", to_java(p), m)) if m else F.lit(default)).otherwise(method)
    line, fetched = F.col("line"), F.col("name") == "fetch"
    given = F.regexp_extract(line, to_java(METHOD), 2)
    method = F.when(fetched & (given != ""), given).otherwise(method)

    auth = REQUESTS[-1][1]
    whole, bearer, basic = (F.regexp_extract_all(line, F.lit(to_java(auth)), F.lit(g)) for g in (2, 3, 4))
    keys = F.transform(F.arrays_zip(bearer.alias("b"), basic.alias("p")), lambda x: F.when(x["b"] != "", x["b"]).when(x["p"] != "", decoded64(x["p"])))
    keys = F.when(F.col("name") == "apollo", F.array().cast("array<string>")).otherwise(F.filter(keys, lambda x: x.isNotNull()))
    block = F.regexp_extract(line, to_java(HEADERS), 1)
    names, values = (F.regexp_extract_all(block, F.lit(to_java(HEADER)), F.lit(g)) for g in (2, 4))
    none = F.array().cast("array<struct<k:string,v:string>>")
    pairs = F.when(fetched, F.arrays_zip(names.alias("k"), values.alias("v"))).when(
        F.col("name") == "apollo", F.array(F.struct(F.lit("Content-Type").alias("k"), F.lit("application/json").alias("v")))
    ).otherwise(none)
    own = F.when(F.col("name") == "apollo", none).otherwise(F.transform(whole, lambda x: F.struct(F.lit("Authorization").alias("k"), x.alias("v"))))
    rows = found.select("path", endpoint.alias("endpoint"), method.alias("method"), "name", "line_no", "ord", "col", F.concat(pairs, own).alias("h"), keys.alias("api_keys"))
    w = W.partitionBy("path", "line_no")
    calls = F.max(F.when(F.col("name") != "auth", 1).otherwise(0)).over(w)
    rows = rows.withColumn("calls", calls).where((F.col("name") != "auth") | (F.col("calls") == 0) & (F.size("api_keys") > 0)).drop("calls", "name")
    rows = first_of(rows, [F.col("path"), F.col("endpoint"), F.col("method")], [F.col("line_no"), F.col("ord"), F.col("col")])
    domain = F.lower(F.regexp_extract("endpoint", r"https?://([^/]+)", 1))
    return rows.select("path", "endpoint", "method", domain.alias("domain"), F.map_from_entries(_last_of(F.col("h"))).alias("headers"), "api_keys", "line_no")


def crawl(
    seeds: DataFrame, edges: DataFrame, depth: int = 3, most: int | None = None, scope: str | None = None, same_host: bool = False, disallowed: DataFrame | None = None,
) -> DataFrame:
    """(url, depth): what is reachable over captured links (url, link), breadth first.

    Links outside the scope (a pattern), on another host than their page, or among the disallowed (url) are not
    followed.  most is the crawl's own limit, by depth and name."""
    if scope:
        edges = edges.where(F.col("link").rlike(to_java(scope)))
    if same_host:
        edges = edges.where(origin(F.col("url")) == origin(F.col("link")))
    if disallowed is not None:
        edges = edges.join(disallowed.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges, "url").select(F.col("link").alias("url")).distinct()
        front = step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(most) if most else seen
