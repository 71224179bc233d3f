"""Technologies that captured responses and source files betray.

Signals are data; each is one expression, and a technology's signals add up by a group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import to_java
from .surface import origin

# Fixed values.  Where, kind, needle, technology, category, confidence, severity, pattern of the version.
# Of the signals with one name in the first column (if any) only the first that holds counts.
SIGNALS = (
    ("powered", "x-powered-by", "has", "php", "php", "language", 80, 1, r"(?i)PHP/(\d+\.\d+(?:\.\d+)?)"),
    ("powered", "x-powered-by", "has", "express", "express", "framework", 80, 2, r"(?i)Express/(\d+\.\d+(?:\.\d+)?)"),
    ("powered", "x-powered-by", "has", "asp.net", "asp_net", "framework", 80, 2, r"(?i)ASP\.NET/(\d+\.\d+(?:\.\d+)?)"),
    ("powered", "x-powered-by", "has", "ruby", "ruby", "language", 80, 1, ""),
    ("powered", "x-powered-by", "has", "passenger", "ruby", "language", 80, 1, ""),
    ("powered", "x-powered-by", "has", "perl", "perl", "language", 80, 1, ""),
    ("powered", "x-powered-by", "has", "uvicorn", "uvicorn", "server", 80, 1, ""),
    ("server", "server", "has", "nginx", "nginx", "server", 60, 1, r"(?i)nginx/(\d+\.\d+(?:\.\d+)?)"),
    ("server", "server", "has", "apache", "apache", "server", 60, 1, r"(?i)Apache/(\d+\.\d+(?:\.\d+)?)"),
    ("server", "server", "has", "cloudflare", "cloudflare", "infrastructure", 70, 1, r"(?i)cloudflare/(\d+)"),
    ("server", "server", "has", "kestrel", "asp_net_core", "framework", 70, 2, r"(?i)Kestrel/(\d+\.\d+(?:\.\d+)?)"),
    ("server", "server", "has", "gunicorn", "python", "language", 60, 1, ""),
    ("server", "server", "has", "uvicorn", "fastapi", "framework", 60, 2, ""),
    ("server", "server", "has", "litespeed", "litespeed", "server", 60, 1, r"(?i)LiteSpeed/(\d+\.\d+(?:\.\d+)?)"),
    ("server", "server", "has", "caddy", "caddy", "server", 60, 1, ""),
    ("", "x-application-context", "set", "", "spring_boot", "framework", 80, 2, ""),
    ("", "x-kubernetes-pf-flowschema-uid", "set", "", "kubernetes", "infrastructure", 90, 3, ""),
    ("", "x-amz-request-id", "set", "", "aws", "infrastructure", 50, 1, ""),
    ("cloudfront", "x-amz-cf-id", "set", "", "cloudfront", "infrastructure", 60, 1, ""),
    ("cloudfront", "x-cache", "is", "cloudfront", "cloudfront", "infrastructure", 60, 1, ""),
    ("", "x-ms-request-id", "set", "", "azure", "infrastructure", 50, 1, ""),
    ("", "x-goog-generation", "set", "", "gcp", "infrastructure", 50, 1, ""),
    ("", "cf-ray", "set", "", "cloudflare", "infrastructure", 60, 1, ""),
    ("", "akamai-origin-hop", "set", "", "akamai", "infrastructure", 60, 1, ""),
    ("", "x-served-by", "set", "", "fastly", "infrastructure", 50, 1, ""),
    ("", "via", "has", "varnish", "varnish", "infrastructure", 50, 1, ""),
    ("generator", "generator", "has", "wordpress", "wordpress", "cms", 80, 3, r"(?i)WordPress\s+(\d+\.\d+(?:\.\d+)?)"),
    ("generator", "generator", "has", "drupal", "drupal", "cms", 80, 3, ""),
    ("generator", "generator", "has", "joomla", "joomla", "cms", 80, 3, ""),
    ("generator", "generator", "has", "hugo", "hugo", "framework", 80, 2, ""),
    ("generator", "generator", "has", "jekyll", "jekyll", "framework", 80, 2, ""),
    ("generator", "generator", "has", "next.js", "nextjs", "framework", 80, 2, ""),
    ("generator", "generator", "has", "nextjs", "nextjs", "framework", 80, 2, ""),
    ("generator", "generator", "has", "nuxt", "nuxtjs", "framework", 80, 2, ""),
    ("", "body", "like", r"__NEXT_DATA__", "nextjs", "framework", 80, 2, ""),
    ("", "body", "like", r"__NUXT__", "nuxtjs", "framework", 80, 2, ""),
    ("", "body", "like", r"__remixContext", "remix", "framework", 80, 2, ""),
    ("", "body", "like", r"__APOLLO_STATE__", "apollo", "library", 70, 1, ""),
    ("", "body", "like", r"wp-content/|wp-includes/", "wordpress", "cms", 60, 3, ""),
    ("", "body", "like", r"sites/default/files/", "drupal", "cms", 60, 3, ""),
    ("", "body", "like", r"cdn\.shopify\.com", "shopify", "cms", 70, 3, ""),
    ("", "body", "like", r"/administrator/", "joomla", "cms", 40, 3, ""),
    ("", "body", "like", r"xmlrpc\.php", "wordpress", "cms", 70, 3, ""),
    ("", "body", "like", r"Whitelabel Error Page", "spring_boot", "framework", 80, 2, ""),
    ("", "body", "like", r"""(?i)/graphql[\s"'/>]|/graphiql[\s"'/>]""", "graphql", "exposed", 60, 3, ""),
    ("", "body", "like", r"__schema", "graphql", "exposed", 70, 3, ""),
    ("", "body", "like", r"(?i)csrf[-_]token", "laravel", "framework", 40, 2, ""),
    ("", "body", "like", r"(?i)Werkzeug", "flask", "framework", 70, 2, ""),
    ("", "body", "like", r'Traceback \(most recent call last\)[\s\S]*File "', "python", "language", 50, 1, ""),
    ("", "body", "like", r"__RequestVerificationToken", "asp_net", "framework", 70, 2, ""),
    ("", "body", "like", r'"kind"\s*:\s*"Status"', "kubernetes", "infrastructure", 70, 3, ""),
    ("", "body", "like", r"jquery[/-](\d+\.\d+(?:\.\d+)*)\.min\.js", "jquery", "library", 60, 1, r"jquery[/-](\d+\.\d+(?:\.\d+)*)\.min\.js"),
    ("", "body", "like", r"__REACT_DEVTOOLS_GLOBAL_HOOK__", "react", "library", 50, 1, ""),
    ("", "body", "like", r"data-v-[a-f0-9]+", "vue", "library", 40, 1, ""),
    ("", "body", "like", r'ng-version="[^"]+"|ng-app="[^"]+"', "angular", "library", 50, 1, ""),
    ("", "cookie", "is", "phpsessid", "php", "language", 50, 1, ""),
    ("", "cookie", "is", "jsessionid", "java", "language", 50, 1, ""),
    ("", "cookie", "is", "connect.sid", "express", "framework", 50, 2, ""),
    ("", "cookie", "is", "csrftoken", "django", "framework", 50, 2, ""),
    ("", "cookie", "is", "laravel_session", "laravel", "framework", 50, 2, ""),
    ("", "cookie", "is", "asp.net_sessionid", "asp_net", "framework", 50, 2, ""),
    ("", "cookie", "is", ".aspnetcore.session", "asp_net_core", "framework", 50, 2, ""),
    ("", "cookie", "starts", "shopify_", "shopify", "cms", 50, 3, ""),
    ("", "cookie", "is", "_rails_session", "rails", "framework", 50, 2, ""),
    ("", "cookie", "is", "session", "flask", "framework", 40, 2, ""),
)
GENERATOR = r"""(?i)<meta[^>]+name\s*=\s*["']generator["'][^>]+content\s*=\s*["']([^"']+)["']"""
LEAST, MOST = 60, 99


def _holds(where: str, kind: str, needle: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """Whether a signal holds, and the text that it is read from."""
    if where == "cookie":
        jar = values["cookies"]
        test = (lambda c: F.lower(c["name"]).startswith(needle)) if kind == "starts" else lambda c: (F.lower(c["name"]) == needle) & (F.lit(needle != "session") | (c["value"] != ""))
        return F.exists(jar, test), F.lit("")
    v = values[where] if where in values else F.coalesce(values["headers"][where], F.lit(""))
    low = F.lower(v)
    return {"has": low.contains(needle), "is": low == needle, "set": v != "", "like": v.rlike(to_java(needle))}[kind], v


def web_signals(responses: DataFrame) -> DataFrame:
    """(url, ord, technology, category, confidence, severity, version) from (url, headers with lower-case
    names, cookies, body)."""
    body = F.coalesce("body", F.lit(""))
    values = {"headers": F.col("headers"), "cookies": F.coalesce(F.col("cookies"), F.array().cast(responses.schema["cookies"].dataType)), "body": body, "generator": F.regexp_extract(body, to_java(GENERATOR), 1)}
    groups: dict[str, list[Column]] = {}
    for n, (group, where, kind, needle, tech, cat, conf, sev, version) in enumerate(SIGNALS):
        test, text = _holds(where, kind, needle, values)
        found = F.regexp_extract(text, to_java(version), 1) if version else F.lit("")
        row = F.struct(F.lit(n).alias("ord"), F.lit(tech).alias("technology"), F.lit(cat).alias("category"), F.lit(conf).alias("confidence"), F.lit(sev).alias("severity"), found.alias("version"))
        groups.setdefault(group or str(n), []).append(F.when(test, row))
    hits = F.array(*(F.coalesce(*g) for g in groups.values()))
    return responses.select("url", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("url", "h.*")


def web_technologies(responses: DataFrame) -> DataFrame:
    """(origin, technology, category, confidence, severity, version): signals of an origin added up, those of
    60 or more."""
    rows = web_signals(responses).withColumn("origin", origin(F.col("url")))
    out = rows.groupBy("origin", "technology").agg(
        F.least(F.sum("confidence"), F.lit(MOST)).cast("int").alias("confidence"), F.max("severity").alias("severity"), F.min_by("category", F.struct("url", "ord")).alias("category"),
        F.coalesce(F.min_by(F.when(F.col("version") != "", F.col("version")), F.when(F.col("version") != "", F.struct("url", "ord"))), F.lit("")).alias("version"),
    )
    return out.where(F.col("confidence") >= LEAST)


# Manifest, substring (lower case), technology, category, severity.
MANIFESTS = (
    ("package.json", '"next":', "nextjs", "framework", 2), ("package.json", '"nuxt":', "nuxtjs", "framework", 2), ("package.json", '"gatsby":', "gatsby", "framework", 2),
    ("package.json", '"express":', "express", "framework", 2), ("package.json", '"react":', "react", "library", 1), ("package.json", '"vue":', "vue", "library", 1),
    ("package.json", '"@angular/core":', "angular", "library", 1), ("composer.json", '"laravel/framework":', "laravel", "framework", 2),
    ("gemfile", "gem 'rails'", "rails", "framework", 2), ("gemfile", 'gem "rails"', "rails", "framework", 2), ("requirements.txt", "django", "django", "framework", 2),
    ("requirements.txt", "flask", "flask", "framework", 2), ("go.mod", "gin-gonic/gin", "gin", "framework", 2), ("go.mod", "gorilla/mux", "gorilla", "framework", 2),
    ("cargo.toml", "actix-web", "actix", "framework", 2), ("cargo.toml", "axum", "axum", "framework", 2), ("pom.xml", "spring-boot", "spring_boot", "framework", 2),
    ("build.gradle", "spring-boot", "spring_boot", "framework", 2),
)
# File names, technology, category, severity.
CONFIGS = (
    (("next.config.js", "next.config.mjs", "next.config.ts"), "nextjs", "framework", 2), (("nuxt.config.js", "nuxt.config.ts"), "nuxtjs", "framework", 2),
    (("gatsby-config.js",), "gatsby", "framework", 2), (("wp-config.php",), "wordpress", "cms", 3),
)
# Substring of script files, technology, category, severity.
IMPORTS = (
    ("from 'react'", "react", "library", 1), ("require('react')", "react", "library", 1), ("from 'vue'", "vue", "library", 1), ("from '@angular'", "angular", "library", 1),
    ("@Component", "angular", "library", 1), ("from 'express'", "express", "framework", 2), ("from 'next/", "nextjs", "framework", 2), ("import flask", "flask", "framework", 2),
    ("from django", "django", "framework", 2),
)


def source_technologies(docs: DataFrame) -> DataFrame:
    """(path, technology, category, severity) from (path, content), each technology once."""
    base, low = F.lower(F.element_at(F.split("path", "/"), -1)), F.lower("content")
    script = F.lower("path").rlike(r"\.(?:js|ts|jsx|tsx|vue|mjs)\z")

    def row(test: Column, tech: str, cat: str, sev: int) -> Column:
        return F.when(test, F.struct(F.lit(tech).alias("technology"), F.lit(cat).alias("category"), F.lit(sev).alias("severity")))

    hits = [row((base == m) & low.contains(s), t, c, v) for m, s, t, c, v in MANIFESTS]
    hits += [row(base.isin(*names), t, c, v) for names, t, c, v in CONFIGS]
    hits.append(row((base == "settings.py") & (low.contains("installed_apps") | low.contains("django.conf.settings")), "django", "framework", 2))
    hits += [row(script & F.col("content").contains(s), t, c, v) for s, t, c, v in IMPORTS]
    each = docs.select("path", F.explode(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))).alias("h"))
    return each.select("path", "h.*").groupBy("path", "technology").agg(F.min("category").alias("category"), F.max("severity").alias("severity"))
