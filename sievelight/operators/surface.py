"""Endpoints, links, storage references, URL classes, response headers and crawl control files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.text import SHORT_CONTEXT, trimmed, truncated
from .matching import line_matches
from .post import first_of

# Patterns whose group 1 is an endpoint, in order.
ENDPOINTS = (
    r"""['"]((?:/api|/v\d+|/internal|/admin|/dashboard|/rest)(?:/[a-zA-Z0-9_\-{}:]+){1,6})['"]""",
    r"""(?i)['"][^'"]*(/[a-z0-9_\-]+/(?:user|account|admin|auth|login|token|password|key|secret|config|setting)[a-z0-9_/\-]*)['"]""",
    r"""(?:fetch|axios\.(?:get|post|put|delete|patch))\s*\(\s*['"](https?://[^'"]+)['"]""",
    r"""(?i)(?:url|endpoint|baseURL|apiURL)\s*[:=]\s*['"](https?://[^'"]{10,})['"]""",
    r"""(wss?://[a-zA-Z0-9\-._]+(?:/[a-zA-Z0-9_/\-]*)?)""",
    r"""['"]((?:https?://[^'"]+)?/(?:openapi|swagger)(?:\.json|\.yaml|/))['"]""",
    r"""['"]((?:https?://[^'"]+)?/v[23]/api-docs)['"]""",
    r"""(?i)['"]?path['"]?\s*[:=]\s*['"]([/][a-zA-Z0-9_\-{}/:]+)['"]""",
    r"""<Route\s+[^>]*path=['"]([/][^'"]+)['"]""",
    r"""(?i)(?:router|navigate|history)\.push\(\s*['"]([/][^'"]+)['"]""",
    r"""(?i)navigate\(\s*['"]([/][^'"]+)['"]""",
    r"""(?i)to=['"]([/][^'"]+)['"]""",
    r"""(?i)href=['"]?(?:[a-z]+:)?([/][a-zA-Z0-9_\-{}]+)['"]?""",
    r"""['"]((?:https?://[^'"]+)?/(?:api/)?graphql(?:/v\d+)?)['"]""",
    r"""['"]((?:https?://[^'"]+)?/query)['"]""",
    r"""['"]((?:https?://[^'"]+)?/gql(?:/v\d+)?)['"]""",
    r"""(?i)['"]?(?:gql|graphql)(?:Client|Endpoint|API)\s*[:=]\s*['"]([^'"]+)['"]""",
    r"""`(https?://[^$`]+\$\{[^}]+\}[^`]*)`""",
    r"""(?i)(?:baseURL|baseUrl|apiUrl|apiURL|endpoint)\s*\+\s*['"]\s*((?:/api|/v\d+|/internal|/admin|/auth)[^'"]+)['"]""",
    r"""(?i)['"]\s*\+\s*['"]((?:/api|/v\d+|/admin|/[a-z]+/[a-z]+))['"]""",
    r"""['"]([^'"]*/(?:v\d+|api/v\d+|version/\d+)(?:/[a-zA-Z0-9_\-{}:]+){0,6})['"]""",
    r"""['"]((?:/api)?/[a-z]+(?:/[a-z]+){0,4})['"]""",
    r"""(?i)['"]?(?:service|svc|upstream|backend|gateway)\s*[:=]\s*['"]([^'"]+)['"]""",
    r"""(?:grpc|gRPC)\s*[:=]\s*['"](https?://[^'"]+)['"]""",
    r"""(?i)['"]([^'"]*(?:upload|import|multipart)[^'"]*)['"]""",
    r"""(?i)['"]([^'"]*(?:webhook|callback|notify|hook)[^'"]*)['"]""",
    r"""['"]((?:/gateway|/proxy|/edge|/cdn|/assets|/static|/media|/files|/attachments)(?:/[a-zA-Z0-9_\-]+){0,4})['"]""",
    r"""(?i)['"]([^'"]*(?:debug|trace|profile|monitor|stats|status|health|readiness|liveness)[^'"]*)['"]""",
    r"""(?i)['"]([^'"]*(?:config|settings|preferences|options|flags|feature|toggle)[^'"]*)['"]""",
    r"""(?i)['"]([^'"]*(?:migrate|migration|schema|seed|database|db|sql|dump)[^'"]*)['"]""",
    r"""(?i)['"]([^'"]*(?:deploy|release|publish|rollback|build|pipeline)[^'"]*)['"]""",
    r"""(?i)['"]([^'"]*(?:internal|private|hidden|secret|legacy|deprecated|old|v0|beta|alpha|canary|preview|experimental)[^'"]*)['"]""",
)
ASSETS = (".png", ".jpg", ".gif", ".css", ".ico", ".woff", ".svg", ".jpeg")
# Pattern, weight, whether an API path is asked for, group.
RISKS = (
    (r"(?i)/users?/(\d+|me|self)\b", 3, True, "idor"),
    (r"(?i)/accounts?/(\d+|me|self)\b", 3, True, "idor"),
    (r"(?i)/(?:me|self|profile)(?:/|$|\?)", 2, True, "idor"),
    (r"(?i)/admin(?:/|$|\?)", 4, False, "admin"),
    (r"(?i)/admin/users?/", 5, False, "admin"),
    (r"(?i)/admin/(?:settings|config|login|panel)", 6, False, "admin"),
    (r"(?i)/(?:internal|debug|private)(?:/|$|\?)", 5, False, "internal"),
    (r"(?i)/(?:actuator|metrics|prometheus)(?:/|$|\?)", 6, False, "actuator"),
    (r"(?i)/actuator/env", 8, False, "actuator"),
    (r"(?i)/actuator/configprops", 8, False, "actuator"),
    (r"(?i)/(?:auth|oauth|token|api-?key|secret)s?(?:/|$|\?)", 4, True, "auth"),
    (r"(?i)/(?:reset|forgot)-?password", 5, False, "reset"),
    (r"(?i)/(?:api/v\d+/)?users?/\{[^}]+\}", 4, True, "template"),
    (r"(?i)/(?:api/v\d+/)?accounts?/\{[^}]+\}", 4, True, "template"),
    (r"(?i)/(?:api/)?graphql(?:/v\d+)?", 2, False, "graphql"),
)
API_PATH = r"(?i)^(?:/api|/v\d+|/internal|/admin|/auth|/actuator)"
# Provider, pattern.
STORAGE = (
    ("aws_s3", r"\b([a-z0-9\-]+\.)?s3([.\-][a-z0-9\-]+)?\.amazonaws\.com\b"),
    ("aws_s3", r"\bs3://([a-z0-9.\-]+)/?\b"),
    ("gcs", r"\bstorage\.googleapis\.com\b"),
    ("gcs", r"\bgs://([a-z0-9.\-_]+)/?\b"),
    ("azure_blob", r"\b([a-z0-9\-]+)\.blob\.core\.windows\.net\b"),
    ("azure_blob", r"\b([a-z0-9\-]+)\.blob\.storage\.azure\.net\b"),
)
# Category, severity, patterns of which one must match.
SURFACES = (
    ("admin", 3, (r"(?i)/(admin|administrator|manage|management|panel|console)(\b|/|$)",)),
    ("auth", 2, (r"(?i)/(login|oauth|token|authorize)(\b|/|$)",)),
    ("debug", 1, (r"(?i)/(debug|trace|diag|diagnostic|healthz|readyz|livez)(\b|/|$)",)),
    ("metrics", 2, (r"(?i)/(metrics|prometheus|statsd|actuator)(\b|/|$)",)),
    ("staging", 1, (r"(?i)/(staging|stg|uat|sit|preprod|dev|test)(\b|[-.]|$)", r"(?i)(staging|stg|uat|preprod|dev|test)([.-])")),
    ("storage", 3, (r"(?i)([a-z0-9.-]+\.)?(s3\.amazonaws\.com|s3\.[a-z0-9-]+\.amazonaws\.com|blob\.core\.windows\.net|storage\.googleapis\.com|storage\.cloud\.google\.com)", r"(?i)/(s3|bucket|blob|storage)/")),
    ("swagger", 2, (r"(?i)(/swagger\.(json|yaml|yml)|/api-docs|/openapi\.(json|yaml|yml))",)),
    ("graphql", 3, (r"(?i)(/graphql(\b|/|$)|/gql(\b|/|$))",)),
)
# The first class whose pattern matches; its severity.
INTERNAL = (
    ("internal", 1, (r"(?i)/(internal|private|intranet|corp)(\b|/|$)", r"(?i)/(?:debug|trace|admin|internal|private|staging|dev|test|sandbox|legacy|hidden)(?:/|$)")),
    ("internal_host", 1, (r"(?i)(internal\.|corp\.|\.local)", r"(?i)(?:[a-z0-9-]+\.){1,3}(?:svc|cluster|local|internal)\b")),
    ("private_ip", 2, (r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b", r"\b192\.168\.\d{1,3}\.\d{1,3}\b")),
    ("localhost", 1, (r"\b(?:localhost|127\.0\.0\.\d+|0\.0\.0\.0)\b",)),
    ("cloud_metadata", 3, (r"\b169\.254\.169\.254\b",)),
    ("container_service", 1, (r"(?i)(?:docker|container)[_.]?(?:host|name|id|service)\b",)),
    ("sensitive_port", 1, (r":(?:3306|5432|6379|27017|9200|9300|11211|5984|8500|8600|8200)\b",)),
)


def endpoints(docs: DataFrame) -> DataFrame:
    """(path, endpoint, line_no, context): each endpoint of a document where it first occurs."""
    found = line_matches(docs.select("path", "content"), [(str(i), p) for i, p in enumerate(ENDPOINTS)], group=1)
    found = found.withColumn("endpoint", trimmed(F.col("value"))).where(F.octet_length("endpoint") >= 5)
    for ext in ASSETS:
        found = found.where(~F.lower("endpoint").endswith(ext))
    found = first_of(found, [F.col("path"), F.col("endpoint")], [F.col("line_no"), F.col("ord"), F.col("col")])
    return found.select("path", "endpoint", "line_no", truncated(trimmed(F.col("line")), SHORT_CONTEXT).alias("context"))


def risk(path: Column) -> Column:
    """The largest weight of each group, summed, at most 10."""
    api, total = path.rlike(to_java(API_PATH)), F.lit(0)
    for group in dict.fromkeys(r[3] for r in RISKS):
        own = [F.when(path.rlike(to_java(p)) & (api if need else F.lit(True)), w).otherwise(0) for p, w, need, g in RISKS if g == group]
        total = total + (F.greatest(*own) if len(own) > 1 else own[0])
    return F.least(total, F.lit(10))


def storage_references(docs: DataFrame) -> DataFrame:
    """(path, url, provider): cloud storage named in a document, each url once."""
    found = line_matches(docs.select("path", "content"), STORAGE)
    found = found.withColumnRenamed("value", "url").withColumnRenamed("name", "provider")
    return first_of(found, [F.col("path"), F.col("url")], [F.col("ord"), F.col("line_no"), F.col("col")]).select("path", "url", "provider")


def _any(url: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(to_java(p))
    return out


def classified(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, category, severity): every class of each url."""
    u = F.col(url)
    hits = [F.when(_any(u, ps), F.struct(F.lit(name).alias("category"), F.lit(sev).alias("severity"))) for name, sev, ps in SURFACES]
    inner = F.lit(None).cast("struct<category:string,severity:int>")
    for name, sev, ps in reversed(INTERNAL):
        inner = F.when(_any(u, ps), F.struct(F.lit(name).alias("category"), F.lit(sev).alias("severity"))).otherwise(inner)
    each = urls.select(u.alias("url"), F.explode(F.filter(F.array(*hits, inner), lambda h: h.isNotNull())).alias("h"))
    return each.select("url", "h.category", "h.severity")


def links(pages: DataFrame) -> DataFrame:
    """(url, link): href and src values of a page, each once."""
    values = F.concat(
        F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*"([^"]*)\""""), F.lit(1)),
        F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*'([^']*)'"""), F.lit(1)),
    )
    return pages.select("url", F.explode(F.array_distinct(values)).alias("link")).where("link != ''")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


# ---- captured responses --------------------------------------------------------------------------------

# Vendor, header, substrings of its value (none: the header alone tells).
FRONTS = (
    ("cloudflare", "server", ("cloudflare",)), ("cloudflare", "cf-ray", ()), ("cloudflare", "cf-cache-status", ()),
    ("akamai", "x-akamai-transformed", ()), ("akamai", "akamai-origin-hop", ()), ("akamai", "server", ("akamaighost",)),
    ("aws_cloudfront", "x-amz-cf-id", ()), ("aws_cloudfront", "x-amz-cf-pop", ()), ("aws_waf", "x-amzn-requestid", ()),
    ("imperva", "x-iinfo", ()), ("imperva", "x-cdn", ("imperva",)), ("sucuri", "x-sucuri-id", ()), ("sucuri", "server", ("sucuri",)),
    ("bigip", "server", ("big-ip",)), ("fortinet", "server", ("fortiweb",)), ("modsecurity", "server", ("mod_security", "modsecurity")),
    ("barracuda", "server", ("barracuda",)), ("datadome", "x-datadome", ()), ("fastly", "x-served-by", ("fastly",)), ("fastly", "x-cache", ("fastly",)),
)


# Code, severity of what a response's headers lack or tell, in order.
HEADER_CODES = (
    ("missing-csp", 3), ("weak-csp-wildcard", 2), ("weak-csp-unsafe-inline", 2), ("weak-csp-unsafe-eval", 2), ("missing-hsts", 2), ("weak-hsts", 1), ("missing-xfo", 2),
    ("missing-xcto", 1), ("missing-referrer-policy", 0), ("missing-permissions-policy", 0), ("cors-wildcard-credentials", 3), ("cors-wildcard", 2), ("cookie-no-secure", 2),
    ("cookie-no-httponly", 1), ("cookie-no-samesite", 1), ("server-version-disclosure", 1), ("x-powered-by-disclosure", 1),
)
# Parts of a content policy that weaken it; the least age of strict transport; policies of cookies.
WILD_POLICY = ("default-src *", "script-src *")
LEAST_AGE = 31_536_000
SAME_SITE = ("strict", "lax", "none")
VERSION = r"\d+\.\d+"


def header_findings(responses: DataFrame) -> DataFrame:
    """(url, code, severity) from (url, headers MAP with lower-case names, cookies ARRAY<STRUCT secure,
    http_only, same_site>): the first response of each origin is judged."""
    first = _first_response(responses)

    def h(name: str) -> Column:
        return F.coalesce(F.col("headers")[name], F.lit(""))

    csp, https, jar = h("content-security-policy"), F.col("url").startswith("https://"), F.coalesce(F.col("cookies"), F.array().cast(responses.schema["cookies"].dataType))
    age = F.regexp_extract(h("strict-transport-security"), r"max-age=([0-9]+)(?:[;, ]|\z)", 1)
    cors, credentials = h("access-control-allow-origin"), F.lower(h("access-control-allow-credentials")) == "true"
    used = https & (F.size(jar) > 0)
    tests = {
        "missing-csp": csp == "", "weak-csp-wildcard": csp.contains(WILD_POLICY[0]) | csp.contains(WILD_POLICY[1]),
        "weak-csp-unsafe-inline": csp.contains("'unsafe-inline'"), "weak-csp-unsafe-eval": csp.contains("'unsafe-eval'"),
        "missing-hsts": https & (h("strict-transport-security") == ""), "weak-hsts": https & (age != "") & (F.try_to_number(age, F.lit("9" * 18)) < LEAST_AGE),
        "missing-xfo": (h("x-frame-options") == "") & ~csp.contains("frame-ancestors"), "missing-xcto": h("x-content-type-options") != "nosniff",
        "missing-referrer-policy": h("referrer-policy") == "", "missing-permissions-policy": h("permissions-policy") == "",
        "cors-wildcard-credentials": (cors == "*") & credentials, "cors-wildcard": (cors == "*") & ~credentials,
        "cookie-no-secure": used & ~F.exists(jar, lambda c: c["secure"]), "cookie-no-httponly": used & ~F.exists(jar, lambda c: c["http_only"]),
        "cookie-no-samesite": used & ~F.exists(jar, lambda c: F.lower(c["same_site"]).isin(*SAME_SITE)),
        "server-version-disclosure": h("server").rlike(VERSION), "x-powered-by-disclosure": h("x-powered-by").rlike(VERSION),
    }
    hits = F.array(*(F.when(tests[code], F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev in HEADER_CODES))
    return first.select("url", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("url", "h.code", "h.severity")


def _first_response(responses: DataFrame) -> DataFrame:
    w = W.partitionBy(origin(F.col("url"))).orderBy("url")
    return responses.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (origin(F.col("url")) != "")).drop("_n")


def fronts(responses: DataFrame) -> DataFrame:
    """(url, vendor): gateways that an origin's headers betray.

    For some vendors the header alone counts, though their other services send it too: a request identifier tells of the
    vendor's front, not that it filters anything."""
    hits = []
    for vendor, name, parts in FRONTS:
        v = F.lower(F.coalesce(F.col("headers")[name], F.lit("")))
        test = v != "" if not parts else F.lit(False)
        for p in parts:
            test = test | v.contains(p)
        hits.append(F.when(test, F.lit(vendor)))
    each = _first_response(responses).select("url", F.explode(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))).alias("vendor"))
    return each


def cookies_of(header: Column) -> Column:
    """Name and value of each pair of a cookie header; pairs without a name are left out."""
    pairs = F.transform(F.split(header, ";"), trimmed)
    pairs = F.filter(pairs, lambda p: p.contains("=") & ~p.startswith("="))
    return F.transform(pairs, lambda p: F.struct(
        trimmed(F.substring_index(p, "=", 1)).alias("name"), F.regexp_replace(trimmed(F.regexp_replace(p, r"^[^=]*=", "")), r'^"|"$', "").alias("value")
    ))


# ---- crawl control and manifests -----------------------------------------------------------------------


def robots_rules(files: DataFrame, agent: str = "sievelight") -> DataFrame:
    """(path, line_no, kind, value) of the lines that hold for the agent, from (path, content): a group holds
    if its name is * or part of the agent's; sitemaps hold for all."""
    raw = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "raw"))
    text = trimmed(F.substring_index("raw", "#", 1))
    pair = raw.select("path", "i", F.lower(trimmed(F.substring_index(text, ":", 1))).alias("kind"), trimmed(F.regexp_replace(text, r"^[^:]*:", "")).alias("value"), text.contains(":").alias("ok")).where("ok")
    mine = F.when(F.col("kind") == "user-agent", (F.col("value") == "*") | F.lit(agent).contains(F.lower("value")))
    w = W.partitionBy("path").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    held = pair.withColumn("mine", F.coalesce(F.last(mine, ignorenulls=True).over(w), F.lit(False)))
    held = held.where((F.col("value") != "") & ((F.col("kind") == "sitemap") | F.col("mine") & F.col("kind").isin("allow", "disallow", "crawl-delay")))
    value = F.when(F.col("kind").isin("allow", "disallow") & ~F.col("value").startswith("/"), F.concat(F.lit("/"), "value")).otherwise(F.col("value"))
    return held.select("path", (F.col("i") + 1).alias("line_no"), "kind", value.alias("value"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed) from urls (url) and robots_rules with the host as path: of a host's rules the first whose
    prefix the url's path has decides; without one the url is allowed."""
    host = F.lower(F.regexp_extract("url", r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    own = urls.select("url").distinct().select("url", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("at"))
    entries = rules.where(F.col("kind").isin("allow", "disallow")).select(F.lower("path").alias("host"), "line_no", "kind", "value")
    hit = own.join(entries, (own["host"] == entries["host"]) & own["at"].startswith(entries["value"]))
    first = hit.groupBy("url").agg(F.min_by("kind", "line_no").alias("kind"))
    return own.join(first, "url", "left").select("url", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(path, loc, is_index) of (path, content) with a urlset (false) or an index of further sitemaps (true)."""
    tag = r"(?is)<(?:[a-z0-9]+:)?loc>(.*?)</(?:[a-z0-9]+:)?loc>"
    index = F.col("content").rlike(r"(?is)<(?:[a-z0-9]+:)?sitemapindex[\s>]")
    locs = F.regexp_extract_all("content", F.lit(tag), F.lit(1))
    return files.select("path", index.alias("is_index"), F.explode(F.transform(locs, trimmed)).alias("loc")).where("loc != ''").select("path", "loc", "is_index")


def sitemap_locations(files: DataFrame) -> DataFrame:
    """(path, loc) of (path, content) with a urlset or an index."""
    return sitemap_entries(files).select("path", "loc")


def sitemap_urls(captured: DataFrame, roots: DataFrame, depth: int = 3, most: int | None = 10_000) -> DataFrame:
    """(url, depth) of the pages that sitemaps name, from the roots (path) down captured (path, content) indexes.

    most is the limit of the crawl that the pages are for, by depth and name; None: all."""
    entries = sitemap_entries(captured)
    front, pages = roots.select("path").distinct(), None
    for level in range(depth):
        here = front.join(entries, "path")
        own = here.where("not is_index").select(F.col("loc").alias("url"), F.lit(level).alias("depth"))
        pages = own if pages is None else pages.unionByName(own)
        front = here.where("is_index").select(F.col("loc").alias("path")).distinct()
    pages = pages.groupBy("url").agg(F.min("depth").alias("depth"))
    return pages.orderBy("depth", "url").limit(most) if most else pages


# Manifests, the file names (lower case) that they go by.
MANIFESTS = ("package.json", "package-lock.json", "requirements.txt", "yarn.lock", "go.mod", "cargo.toml")
REGISTRY_TOKEN = r"//registry\.npmjs\.org/:_authToken\s*=\s*(\S+)"


def package_entries(files: DataFrame) -> DataFrame:
    """(path, line_no, name, mutable, secret): loose or foreign dependencies in (path, content) manifests.

    A package.json with a registry token gives the first token alone."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = files.select("path", base.alias("base"), F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).where(F.col("base").isin(*MANIFESTS))
    t = trimmed(F.col("line"))
    w = W.partitionBy("path").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    section = F.last(F.when(t.startswith("["), t == "[dependencies]"), ignorenulls=True).over(w)
    token = F.when(F.col("base") == "package.json", F.nullif(F.regexp_extract("line", to_java(REGISTRY_TOKEN), 1), F.lit("")))
    given = F.min(F.when(token.isNotNull(), F.struct("i", token.alias("secret")))).over(W.partitionBy("path"))
    rows = rows.withColumn("deps", F.coalesce(section, F.lit(False))).withColumn("name", t).withColumn("given", given)
    b, n = F.col("base"), F.col("name")
    keep = (
        (b.isin("package.json", "package-lock.json") & (n.contains('"*"') | n.contains("latest")))
        | ((b == "requirements.txt") & (n != "") & ~n.startswith("#") & ~n.startswith("-") & (n.contains("git+") | n.contains("@")))
        | ((b == "yarn.lock") & F.col("line").startswith('  resolved "') & (n.contains("http://") | n.contains("https://")))
        | ((b == "go.mod") & ~n.startswith("//") & n.endswith("// indirect"))
        | ((b == "cargo.toml") & F.col("deps") & ~n.startswith("[") & n.contains("=") & ~n.contains("path") & (n.contains('"*"') | n.contains("git =") | n.contains("git+")))
    )
    mutable = b.isin("package.json", "package-lock.json", "cargo.toml") | ((b == "requirements.txt") & n.contains(">="))
    loose = rows.where(keep & F.col("given").isNull()).select("path", (F.col("i") + 1).alias("line_no"), "name", mutable.alias("mutable"), F.lit("").alias("secret"))
    tokens = rows.where(F.col("given").isNotNull() & (F.col("given.i") == F.col("i")))
    return loose.unionByName(tokens.select("path", (F.col("i") + 1).alias("line_no"), F.lit(".npmrc").alias("name"), F.lit(False).alias("mutable"), F.col("given.secret").alias("secret")))


def candidates(origins: DataFrame, paths: list[str]) -> DataFrame:
    """(url, path): addresses of the given paths at each origin, for a look at what was captured."""
    return origins.select("origin").distinct().select("origin", F.explode(F.array(*map(F.lit, paths))).alias("path")).select(F.concat("origin", "path").alias("url"), "path")


def captured_paths(captured: DataFrame, paths: list[str]) -> DataFrame:
    """(url, path, content): captured pages (url, status, content) that answered on one of the paths; * in a path
    stands for anything but a slash."""
    at = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    like = [(p, "^" + "[^/]*".join(re.escape(x) for x in p.split("*")) + r"\z") for p in paths]
    hit = F.coalesce(*(F.when(at.rlike(x), p) for p, x in like)) if like else F.lit(None).cast("string")
    return captured.where((F.col("status") >= 200) & (F.col("status") < 300)).select("url", hit.alias("path"), "content").where("path is not null")
