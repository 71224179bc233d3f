"""Corpora that the queries read: tables of a folder, and texts that are derived from keys alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, post, technology
from ..operators.surface import FRONTS
from ..sources import corpora


def derived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a path as one file, in the order of their keys."""
    rows = corpora.derived(spark, sf_dir).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "content"))).alias("c"))
    return rows.select("path", F.array_join(F.col("c.content"), "\n").alias("content"))


def _planted_texts(k: Column, h: Column) -> list[Column]:
    def text(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def cut(a: int, n: int) -> Column:
        return F.substring(h, a, n)

    def big(a: int, n: int) -> Column:
        return F.upper(cut(a, n))

    return [
        text('x = "AKIA" + "', big(1, 16), '";'),
        text('var a = "ghp_', cut(1, 18), '";\nvar b = "', cut(19, 18), '";\nvar c = a + b;'),
        text('k = ok ? "AKIA', big(1, 16), '" : "sk_live_', cut(1, 24), '";'),
        text('var arr = ["zz", "AKIA', big(1, 16), '"];\nuse(arr[1], arr[7], other[0]);'),
        text("t = `AKIA", big(1, 16), "`;"),
        text('j = ["AKIA", "', big(1, 8), '", "', big(9, 8), '"].join("");'),
        text("see https://h.example.com/cb?x=1&access_token=", cut(1, 20), " now"),
        text("session secret: ", F.base64(F.unhex(h)), " end"),
        text("s3://bucket-", k, "/x and gs://b_", k, "/y or acct", k, ".blob.core.windows.net here"),
        text("X-API-Key: ", cut(1, 32), "\nX-Auth-Token: Bearer ", cut(1, 40), "\nAuthToken=", cut(1, 20), "\nAuthorization: Basic ", cut(1, 24)),
        text('process.env.API_KEY; baseURL = "https://x.example.com/v1/u"; apiKey: "', cut(1, 20), '"; internal = "https://corp.example.com/', k, '"; localhost:8080'),
        text('var b64 = "', F.base64(text("http://key.example.com/very/long/", k).cast("binary")), '";'),
        text('__webpack_require__(); import("./chunk-', k, '.js"); load("conf/credentials.json"); go("/debug/', k, '");'),
        text('fetch("https://api.example.com/v1/users/', k, '", {method: "POST", headers: {"X-Key": "v', k, '", "Authorization": "Bearer ', cut(1, 20), "\"}});\naxios.put('https://b.example.com/", k, "')\nq.open(\"GET\", \"/z/", k, '")\n"Authorization": "Basic ', F.base64(text("u:", k, "0000").cast("binary")), '"'),
        text("// TODO: rotate the key ", k, "\n// https://api.example.com/", k, "\n/admin/users/", k, " '/admin/users/", k, "'"),
        text('{"a": {"password": "', cut(1, 20), '"}, "l": ["AKIA', big(1, 16), '", {"n": 1}]}'),
    ]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a script (or JSON file) of one of sixteen kinds for each customer."""
    key = F.col("c_custkey")
    k = key.cast("string")
    kind = F.get(F.array(*_planted_texts(k, F.sha2(k, 256))), (key % 16).cast("int"))
    path = F.concat(F.lit("web/p"), (key % 5).cast("string"), F.lit("/s"), k, F.when(key % 16 == 15, ".json").otherwise(".js"))
    return corpora.spread(corpora.read(spark, sf_dir, "customer").select("c_custkey")).select(path.alias("path"), kind.alias("content"))


PLANTED_SQL = r"""SELECT 'web/p' || (key % 5)::VARCHAR || '/s' || k || CASE WHEN key % 16 = 15 THEN '.json' ELSE '.js' END AS path,
 CASE key % 16
  WHEN 0 THEN 'x = "AKIA" + "' || upper(h[1:16]) || '";'
  WHEN 1 THEN 'var a = "ghp_' || h[1:18] || '";' || chr(10) || 'var b = "' || h[19:36] || '";' || chr(10) || 'var c = a + b;'
  WHEN 2 THEN 'k = ok ? "AKIA' || upper(h[1:16]) || '" : "sk_live_' || h[1:24] || '";'
  WHEN 3 THEN 'var arr = ["zz", "AKIA' || upper(h[1:16]) || '"];' || chr(10) || 'use(arr[1], arr[7], other[0]);'
  WHEN 4 THEN 't = `AKIA' || upper(h[1:16]) || '`;'
  WHEN 5 THEN 'j = ["AKIA", "' || upper(h[1:8]) || '", "' || upper(h[9:16]) || '"].join("");'
  WHEN 6 THEN 'see https://h.example.com/cb?x=1&access_token=' || h[1:20] || ' now'
  WHEN 7 THEN 'session secret: ' || to_base64(unhex(h)) || ' end'
  WHEN 8 THEN 's3://bucket-' || k || '/x and gs://b_' || k || '/y or acct' || k || '.blob.core.windows.net here'
  WHEN 9 THEN 'X-API-Key: ' || h[1:32] || chr(10) || 'X-Auth-Token: Bearer ' || h[1:40] || chr(10) || 'AuthToken=' || h[1:20] || chr(10) || 'Authorization: Basic ' || h[1:24]
  WHEN 10 THEN 'process.env.API_KEY; baseURL = "https://x.example.com/v1/u"; apiKey: "' || h[1:20] || '"; internal = "https://corp.example.com/' || k || '"; localhost:8080'
  WHEN 11 THEN 'var b64 = "' || to_base64(encode('http://key.example.com/very/long/' || k)) || '";'
  WHEN 12 THEN '__webpack_require__(); import("./chunk-' || k || '.js"); load("conf/credentials.json"); go("/debug/' || k || '");'
  WHEN 13 THEN 'fetch("https://api.example.com/v1/users/' || k || '", {method: "POST", headers: {"X-Key": "v' || k || '", "Authorization": "Bearer ' || h[1:20] || '"}});' || chr(10)
   || 'axios.put(''https://b.example.com/' || k || ''')' || chr(10) || 'q.open("GET", "/z/' || k || '")' || chr(10) || '"Authorization": "Basic ' || to_base64(encode('u:' || k || '0000')) || '"'
  WHEN 14 THEN '// TODO: rotate the key ' || k || chr(10) || '// https://api.example.com/' || k || chr(10) || '/admin/users/' || k || ' ''/admin/users/' || k || ''''
  ELSE '{"a": {"password": "' || h[1:20] || '"}, "l": ["AKIA' || upper(h[1:16]) || '", {"n": 1}]}'
 END AS content
FROM (SELECT c_custkey AS key, c_custkey::VARCHAR AS k, sha256(c_custkey::VARCHAR) AS h FROM customer)"""
corpora.SQL["planted"] = PLANTED_SQL
# Files of the derived corpus: entries of a path joined in the order of their keys.
corpora.SQL["derived_files"] = f"SELECT path, string_agg(content, chr(10) ORDER BY k) AS content FROM ({corpora.SQL['derived']}) GROUP BY path"

CORPORA = {
    "documents": corpora.documents, "pages": corpora.pages, "conversations": corpora.conversations, "benchmark": corpora.benchmark,
    "derived": lambda s, d: corpora.derived(s, d).select("path", "content"), "derived_files": derived_files, "planted": planted,
}


def unique_findings(spark: SparkSession, d: str) -> DataFrame:
    return post.deduplicated(detect.scan_rules(derived_files(spark, d)))


def lower_findings(spark: SparkSession, d: str) -> DataFrame:
    return post.downgraded(unique_findings(spark, d))


# ---- captured responses --------------------------------------------------------------------------------

#: A text for each pattern that a page's body is searched for.
BODY_SAMPLES = {
    r"__NEXT_DATA__": "id=__NEXT_DATA__", r"__NUXT__": "window.__NUXT__", r"__remixContext": "__remixContext", r"__APOLLO_STATE__": "__APOLLO_STATE__",
    r"wp-content/|wp-includes/": "/wp-content/x", r"sites/default/files/": "/sites/default/files/x", r"cdn\.shopify\.com": "cdn.shopify.com", r"/administrator/": "/administrator/",
    r"xmlrpc\.php": "/xmlrpc.php", r"Whitelabel Error Page": "Whitelabel Error Page", r"""(?i)/graphql[\s"'/>]|/graphiql[\s"'/>]""": "/GraphQL/", r"__schema": "__schema",
    r"(?i)csrf[-_]token": "CSRF-Token", r"(?i)Werkzeug": "werkzeug", r'Traceback \(most recent call last\)[\s\S]*File "': 'Traceback (most recent call last)\n File "',
    r"__RequestVerificationToken": "__RequestVerificationToken", r'"kind"\s*:\s*"Status"': '"kind": "Status"', r"jquery[/-](\d+\.\d+(?:\.\d+)*)\.min\.js": "jquery-3.6.1.min.js",
    r"__REACT_DEVTOOLS_GLOBAL_HOOK__": "__REACT_DEVTOOLS_GLOBAL_HOOK__", r"data-v-[a-f0-9]+": "data-v-0a1b", r'ng-version="[^"]+"|ng-app="[^"]+"': 'ng-version="12"',
}
_VERSIONED = {"nginx": "nginx/1.25.3", "apache": "Apache/2.4.1", "cloudflare": "cloudflare/7", "php": "PHP/8.1", "express": "Express/4.17", "asp.net": "ASP.NET/4.0", "kestrel": "Kestrel/2.0", "litespeed": "LiteSpeed/5.4", "wordpress": "WordPress 6.1"}


def signal_samples() -> list[tuple[str, str, str]]:
    """(place, name, value) that each signal of a technology holds for: a header, a cookie or a body."""
    out = []
    for _, where, kind, needle, *_ in technology.SIGNALS:
        text = _VERSIONED.get(needle, needle)
        if where == "generator":
            out.append(("body", "", f'<meta name="generator" content="{text}">'))
        elif where == "body":
            out.append(("body", "", BODY_SAMPLES[needle]))
        elif where == "cookie":
            out.append(("cookie", needle.upper() if kind == "is" else needle + "x", "v"))
        else:
            out.append(("header", where, "x" if kind == "set" else text))
    return out


def front_samples() -> list[tuple[str, str, str]]:
    return [("header", name, f"a {parts[-1].upper()} b" if parts else "x") for _, name, parts in FRONTS]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def samples_sql(samples: list[tuple[str, str, str]]) -> str:
    """(url, place, name, value): a response with one of the samples for each order."""
    rows = ", ".join(f"({i}, {quoted(p)}, {quoted(n)}, {quoted(v)})" for i, (p, n, v) in enumerate(samples))
    return f"SELECT 'https://h' || o_orderkey || '.example.com/x' AS url, place, name, value FROM orders JOIN (VALUES {rows}) AS s(i, place, name, value) ON o_orderkey % {len(samples)} = i"


def sample_responses(spark: SparkSession, d: str, samples: list[tuple[str, str, str]]) -> DataFrame:
    """(url, headers, cookies, body): a response with one of the samples for each order."""
    at = (F.col("o_orderkey") % len(samples)).cast("int")
    place, name, value = (F.get(F.array(*(F.lit(s[j]) for s in samples)), at) for j in range(3))
    rows = corpora.read(spark, d, "orders").select(F.concat(F.lit("https://h"), F.col("o_orderkey").cast("string"), F.lit(".example.com/x")).alias("url"), place.alias("p"), name.alias("n"), value.alias("v"))
    cookie = "struct<name:string,value:string,secure:boolean,http_only:boolean,same_site:string>"
    jar = F.when(F.col("p") == "cookie", F.array(F.struct(F.col("n").alias("name"), F.col("v").alias("value"), F.lit(True).alias("secure"), F.lit(True).alias("http_only"), F.lit("lax").alias("same_site"))))
    headers = F.when(F.col("p") == "header", F.create_map("n", "v")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("url", headers.alias("headers"), F.coalesce(jar, F.array().cast(f"array<{cookie}>")).alias("cookies"), F.when(F.col("p") == "body", F.col("v")).otherwise("").alias("body"))
