"""Queries of what happens to findings after a scan: caches, verdicts, suppression, verification, summaries, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import post, state
from ..sources import corpora, reports
from . import sql
from .fixtures import lower_findings, unique_findings
from .registry import NOW, register

_UNIQUE = sql.deduplicated("derived_files")
_LOWER = sql.downgraded("derived_files")
_THEN = "2025-01-01 00:00:00"


@register(
    "cache_upsert",
    _UNIQUE + f""", f AS (SELECT DISTINCT {sql.FINGERPRINT} AS fingerprint, rule, path FROM unique_findings) SELECT fingerprint, rule, path, CASE WHEN path LIKE 'src/3%' THEN '{_THEN}' ELSE '{NOW}' END AS first_seen,
 CASE WHEN path LIKE 'src/4%' THEN '{_THEN}' ELSE '{NOW}' END AS last_seen FROM f WHERE path NOT LIKE 'src/4%' UNION ALL SELECT fingerprint, rule, path, '{_THEN}', '{_THEN}' FROM f WHERE path LIKE 'src/4%'""",
)
def _upsert(spark, d):
    found = unique_findings(spark, d)
    then = F.lit(_THEN).cast("timestamp")
    old = post.with_fingerprints(found.where("path LIKE 'src/3%' or path LIKE 'src/4%'")).select("fingerprint", "rule", "path").distinct()
    cache = old.select("*", then.alias("first_seen"), then.alias("last_seen"))
    out = post.upserted(cache, found.where("path NOT LIKE 'src/4%'"), F.lit(NOW).cast("timestamp"))
    return out.select("fingerprint", "rule", "path", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")))


@register("new_findings", _UNIQUE + " SELECT path, line_no, rule, secret FROM unique_findings WHERE path NOT LIKE 'src/3%'")
def _new(spark, d):
    found = unique_findings(spark, d)
    cache = post.with_fingerprints(found.where("path LIKE 'src/3%'")).select("fingerprint")
    return post.with_novelty(found, cache).where("is_new").select("path", "line_no", "rule", "secret")


@register(
    "url_cache",
    f"""WITH p AS (SELECT page_id, url, html FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY 200 + page_id % 2 DESC, left(sha256(html), 32) DESC) = 1)
 SELECT left(sha256(url), 32) AS url_hash, url, 200 + page_id % 2 AS status, left(sha256(html), 32) AS content_hash, CASE WHEN page_id % 3 = 0 THEN '{_THEN}' ELSE '{NOW}' END AS first_seen, '{NOW}' AS last_seen FROM p""",
)
def _url_cache(spark, d):
    pages = corpora.read(spark, d, "pages").select("page_id", "url", (F.lit(200) + F.col("page_id") % 2).alias("status"), F.col("html").alias("content"))
    last = pages.groupBy("url").agg(F.max_by("page_id", F.struct("status", state.short_hash(F.col("content")))).alias("page_id"))
    then = F.lit(_THEN).cast("timestamp")
    cache = last.where("page_id % 3 = 0").select(state.short_hash(F.col("url")).alias("url_hash"), "url", F.lit(500).cast("long").alias("status"), F.lit("old").alias("content_hash"), then.alias("first_seen"), then.alias("last_seen"))
    out = state.recorded_urls(cache, pages.select("url", "status", "content"), F.lit(NOW).cast("timestamp"))
    return out.select("url_hash", "url", "status", "content_hash", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")))


@register("unseen_urls", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def _unseen(spark, d):
    pages = corpora.read(spark, d, "pages")
    cache = pages.select("url", F.when(F.col("page_id") % 4 == 0, 200).otherwise(404).alias("status"))
    return state.unseen(pages.select("url").distinct(), cache)


@register("changed_pages", "SELECT page_id, url FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
def _changed(spark, d):
    pages = corpora.read(spark, d, "pages").select("page_id", F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("key"), F.col("url").alias("address"), F.col("html").alias("content"))
    known = F.when(F.col("page_id") % 2 == 0, "other").otherwise(state.short_hash(F.col("content")))
    cache = pages.where("page_id % 3 != 0").select(F.col("key").alias("url"), F.lit(200).alias("status"), known.alias("content_hash"))
    out = state.changed(pages.select("page_id", F.col("key").alias("url"), F.lit(200).alias("status"), "address", "content"), cache)
    return out.select("page_id", F.col("address").alias("url"))


@register(
    "verdicts_checked",
    _UNIQUE + f""", f AS (SELECT DISTINCT {sql.FINGERPRINT} AS fingerprint FROM unique_findings), v AS (SELECT 'unknown' || n_nationkey AS fingerprint, 'tp' AS verdict FROM nation
 UNION ALL SELECT fingerprint, CASE left(fingerprint, 1) WHEN '0' THEN 'maybe' WHEN '1' THEN 'tp' ELSE 'fp' END FROM f)
 SELECT fingerprint, verdict, CASE WHEN verdict NOT IN ('tp', 'fp') THEN 'verdict must be tp or fp' WHEN fingerprint LIKE 'unknown%' THEN 'unknown fingerprint' END AS problem FROM v""",
)
def _verdicts(spark, d):
    known = post.with_fingerprints(unique_findings(spark, d)).select("fingerprint").distinct()
    digit = F.substring("fingerprint", 1, 1)
    given = known.select("fingerprint", F.when(digit == "0", "maybe").when(digit == "1", "tp").otherwise("fp").alias("verdict"))
    strange = corpora.read(spark, d, "nation").select(F.concat(F.lit("unknown"), F.col("n_nationkey").cast("string")).alias("fingerprint"), F.lit("tp").alias("verdict"))
    return state.checked_verdicts(given.unionByName(strange), known)


@register("state_counts", "SELECT (SELECT count(*) FROM events) AS verdicts, count(*) AS urls, count(*) FILTER (WHERE page_id % 2 = 0) AS seen FROM pages")
def _counts(spark, d):
    urls = corpora.read(spark, d, "pages").select("url", (200 + F.col("page_id") % 2).alias("status"))
    return state.counts(corpora.read(spark, d, "events"), urls)


@register(
    "urls_on_live_hosts",
    "WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY ALL) SELECT url FROM pages WHERE lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) IN (SELECT host FROM h WHERE n > 1)",
)
def _live(spark, d):
    pages = corpora.read(spark, d, "pages")
    hosts = pages.groupBy(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.upper("host").alias("host"))
    return state.on_live_hosts(pages.select("url"), hosts)


@register("found_in_raw_only", _UNIQUE + " SELECT path, line_no, rule, secret FROM unique_findings WHERE (path, left(secret, 60)) NOT IN (SELECT path, left(secret, 60) FROM unique_findings WHERE rule = 'generic_secret')")
def _raw_only(spark, d):
    found = unique_findings(spark, d)
    return state.not_found_before(found, found.where("rule = 'generic_secret'")).select("path", "line_no", "rule", "secret")


@register("validated_findings", _LOWER + " SELECT path, line_no, rule, secret, CASE WHEN rule = 'google_api_key' AND secret[5:5] < '8' THEN 0 ELSE severity END AS severity FROM lower_findings")
def _validated(spark, d):
    found = lower_findings(spark, d)
    known = found.where("rule = 'google_api_key'").select("secret", (F.substring("secret", 5, 1) >= "8").alias("valid")).distinct()
    return post.validated(found, known).select("path", "line_no", "rule", "secret", "severity")


@register(
    "verified_findings",
    _UNIQUE + """ SELECT path, line_no, rule, secret, CASE rule WHEN 'google_api_key' THEN CASE WHEN secret[5:5] < '8' THEN 'POTENTIAL' ELSE 'LIKELY' END WHEN 'slack_bot_token' THEN 'VERIFIED' ELSE '' END AS verification_status FROM unique_findings""",
)
def _verified(spark, d):
    found = unique_findings(spark, d)
    google = found.where("rule = 'google_api_key'").select("secret", (F.substring("secret", 5, 1) >= "8").alias("valid"), F.lit("unknown").alias("state"))
    slack = found.where("rule = 'slack_bot_token'").select("secret", F.lit(True).alias("valid"), F.lit("verified").alias("state"))
    return post.verification(found, google.unionByName(slack)).select("path", "line_no", "rule", "secret", "verification_status")


@register(
    "format_states",
    _UNIQUE + " SELECT path, line_no, rule, CASE WHEN starts_with(rule, 'aws_') THEN CASE WHEN starts_with(secret, 'AKIA') AND length(secret) >= 16 THEN 'LIKELY' ELSE 'POTENTIAL' END WHEN starts_with(secret, 'sk-') THEN 'POTENTIAL' ELSE 'UNKNOWN' END AS state FROM unique_findings",
)
def _states(spark, d):
    return unique_findings(spark, d).select("path", "line_no", "rule", post.format_state(F.col("rule"), F.col("secret")).alias("state"))


@register("findings_for_display", _UNIQUE + " SELECT path, secret, min(line_no) AS line_no FROM unique_findings GROUP BY ALL")
def _display(spark, d):
    return post.for_display(unique_findings(spark, d)).select("path", "secret", "line_no")


@register("scan_summary", _LOWER + " SELECT count(*) AS findings, count(DISTINCT path) AS files, count(*) FILTER (WHERE rule LIKE 'endpoint%' OR rule LIKE 'openapi\\_%' ESCAPE '\\' OR rule LIKE 'graphql\\_%' ESCAPE '\\') AS endpoints FROM lower_findings")
def _summary(spark, d):
    return post.scan_summary(lower_findings(spark, d))


@register("summary_risk", sql.endpoint_findings("planted").join(("SELECT risk, count(*) AS findings FROM (", ") GROUP BY risk")))
def _risk(spark, d):
    from ..operators import findings
    from .fixtures import planted

    return post.by_risk(findings.endpoint_findings(planted(spark, d)))


_NAMES = "['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][severity + 1]"


@register(
    "report_lines",
    _UNIQUE + f""", m AS (SELECT *, left(secret, 4) || repeat('*', greatest(length(secret) - 4, 0)::INT) AS masked FROM unique_findings), e AS (SELECT *, replace(context, secret, masked) AS shown FROM m)
 SELECT path AS file, line_no AS line, rule, {_NAMES} AS severity, CASE WHEN regexp_matches(masked, '[,"\\n\\r]') THEN '"' || replace(masked, '"', '""') || '"' ELSE masked END AS secret, printf('%.3f', entropy) AS entropy,
 CASE WHEN regexp_matches(shown, '[,"\\n\\r]') THEN '"' || replace(shown, '"', '""') || '"' ELSE shown END AS context FROM e""",
)
def _lines(spark, d):
    from ..functions.text import csv_escaped

    return reports.rows(unique_findings(spark, d)).select("file", "line", "rule", "severity", csv_escaped(F.col("secret")).alias("secret"), "entropy", csv_escaped(F.col("context")).alias("context"))
