"""What happens to findings: deduplication, downgrade, suppression, novelty, validation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.text import cache_fingerprint, extension, ignore_fingerprint, trimmed

# Fixed values.
NON_PRODUCTION = (
    "test", "tests", "spec", "specs", "__tests__", "example", "examples", "demo", "demos", "samples", "dummy", "mock", "mocks", "fixtures",
    "fixture", "stubs", "vendor", "third_party",
)
PLACEHOLDER = r"(?i)\b(?:example|placeholder|changeme|change_me|your[-_](?:key|secret|token|password)|sample|TODO|FIXME|xxxxx|yyyyy|test[-_]?value|dummy)\b"
CATEGORIES = (
    ("secrets", ("secret", "api_key", "token", "password", "credential", "aws_access", "github_token", "stripe")),
    ("juicy_files", ("juicy_file", "source_map")),
    ("endpoints", ("endpoint", "openapi", "graphql")),
    ("security_headers", ("security-header", "attack_surface")),
    ("internal_urls", ("internal", "private_ip", "cloud_metadata", "localhost")),
)


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ties go by all columns, so the result is one."""
    w = W.partitionBy(*keys).orderBy(*order, *(F.col(c) for c in df.columns))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for rule, secret, path and the first 40 characters of the context."""
    keys = [F.col("rule"), F.col("secret"), F.col("path"), F.substring("context", 1, 40)]
    return first_of(findings, keys, [F.col("stage_ord"), F.col("line_no"), F.col("col")])


def downgraded(findings: DataFrame) -> DataFrame:
    """One step down in test-like folders; INFO where the context is a placeholder."""
    folder = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, NON_PRODUCTION)))
    sev = F.when(folder & (F.col("severity") > 0), F.col("severity") - 1).otherwise(F.col("severity"))
    return findings.withColumn("severity", F.when(F.col("context").rlike(to_java(PLACEHOLDER)), 0).otherwise(sev))


def with_fingerprints(findings: DataFrame) -> DataFrame:
    at = F.col("rule"), F.col("secret"), F.col("path")
    return findings.withColumn("fingerprint", cache_fingerprint(*at)).withColumn("ignore_id", ignore_fingerprint(*at))


def ignore_rules(text: str) -> tuple[list[str], list[str]]:
    """Fingerprints and patterns of an ignore file: # starts a comment, re: a pattern."""
    marks, patterns = [], []
    for line in text.split("\n"):
        line = line.split("#", 1)[0].strip()
        if line.startswith("re:"):
            patterns.append(line[3:])
        elif line:
            marks.append(line)
    return marks, patterns


def not_ignored(findings: DataFrame, fingerprints: DataFrame, patterns: list[str]) -> DataFrame:
    """fingerprints: a column ignore_id."""
    out = with_fingerprints(findings).join(fingerprints.select("ignore_id").distinct(), "ignore_id", "left_anti")
    for p in patterns:
        out = out.where(~F.col("secret").rlike(to_java(p)) & ~F.col("path").rlike(to_java(p)))
    return out.select(*findings.columns)


def with_novelty(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """is_new: the fingerprint is not in the cache."""
    seen = cache.select("fingerprint", F.lit(True).alias("_seen")).distinct()
    out = with_fingerprints(findings).join(seen, "fingerprint", "left")
    return out.withColumn("is_new", F.col("_seen").isNull()).select(*findings.columns, "fingerprint", "is_new")


def upserted(cache: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """The cache (fingerprint, rule, path, first_seen, last_seen) after a run."""
    fresh = with_fingerprints(findings).groupBy("fingerprint").agg(F.min("rule").alias("rule_"), F.min("path").alias("path_"))
    both = cache.join(fresh, "fingerprint", "full_outer")
    hit = F.col("rule_").isNotNull()
    return both.select(
        "fingerprint", F.coalesce("rule", "rule_").alias("rule"), F.coalesce("path", "path_").alias("path"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def validated(findings: DataFrame, validation: DataFrame) -> DataFrame:
    """Findings whose secret is known as invalid become INFO; validation: (secret, valid)."""
    out = findings.join(validation.select("secret", F.col("valid").alias("_valid")), "secret", "left")
    return out.withColumn("severity", F.when(~F.coalesce("_valid", F.lit(True)), 0).otherwise(F.col("severity"))).select(*findings.columns)


# What decoders put before a rule's name.
DECODED = ("base64_", "hex_", "url_", "unicode_")


def provider_name(rule: Column) -> Column:
    """A rule's name without its first part and what decoders put before it."""
    out = F.when(rule.contains("_"), F.regexp_replace(rule, "^[^_]*_", "")).otherwise(rule)
    for p in DECODED:
        out = F.regexp_replace(out, "^" + p, "")
    return out


def format_state(rule: Column, secret: Column) -> Column:
    """What the form of a value says: likely for full-length access keys, potential for other known kinds."""
    s, name = trimmed(secret), provider_name(rule)
    aws = rule.startswith("aws_") | name.startswith("aws_") | name.isin("access_key", "access_key_id")
    return F.when(aws & s.startswith("AKIA") & (F.length(s) >= 16), "LIKELY").when(aws, "POTENTIAL").when(s.startswith("sk-"), "POTENTIAL").otherwise("UNKNOWN")


def verification(findings: DataFrame, results: DataFrame) -> DataFrame:
    """findings with verification_status from results (secret, valid, state): the state if it says anything, else likely
    for valid and potential for other values; empty without a result."""
    own = results.groupBy("secret").agg(F.max(F.struct("valid", F.upper("state").alias("state"))).alias("_r")).select("secret", F.col("_r.valid").alias("_valid"), F.col("_r.state").alias("_state"))
    out = findings.join(own, "secret", "left")
    told = F.when(F.col("_state").isin("VERIFIED", "LIKELY", "POTENTIAL"), F.col("_state")).when(F.col("_valid"), "LIKELY").when(F.col("_valid").isNotNull(), "POTENTIAL").otherwise("")
    return out.withColumn("verification_status", told).select(*findings.columns, "verification_status")


def category(rule: Column) -> Column:
    out = F.lit("other")
    for name, parts in reversed(CATEGORIES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | rule.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"))


def by_extension(findings: DataFrame) -> DataFrame:
    ext = F.lower(extension(F.col("path")))
    return findings.groupBy(F.when(ext == "", "(no ext)").otherwise(ext).alias("ext")).agg(F.count(F.lit(1)).alias("findings"))


def by_risk(findings: DataFrame) -> DataFrame:
    return findings.where("risk >= 0").groupBy("risk").agg(F.count(F.lit(1)).alias("findings"))


# Beginnings of the names of findings that are endpoints.
ENDPOINT_RULES = ("endpoint", "openapi_", "graphql_")


def scan_summary(findings: DataFrame) -> DataFrame:
    """One row: findings, files with any, and how many are endpoints."""
    ends = F.lit(False)
    for p in ENDPOINT_RULES:
        ends = ends | F.col("rule").startswith(p)
    return findings.agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"), F.count_if(ends).alias("endpoints"))


def for_display(findings: DataFrame) -> DataFrame:
    """One finding for a path and secret, the first in the order of detectors and places."""
    return first_of(findings, [F.col("path"), F.col("secret")], [F.col("stage_ord"), F.col("line_no"), F.col("col")])


def probes_in_order(probes: DataFrame) -> DataFrame:
    """Probes (param, interesting, status), the interesting ones first, then by status."""
    return probes.orderBy(F.desc("interesting"), "status", "param")


def rules_in_order(rules: DataFrame) -> DataFrame:
    """Rules, the gravest first, then by name."""
    return rules.orderBy(F.desc("severity"), "rule")


def tech_band(confidence: Column) -> Column:
    return F.when(confidence >= 95, "CRITICAL").when(confidence >= 80, "HIGH").when(confidence >= 60, "MEDIUM").otherwise("LOW")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy(category(F.col("rule")).alias("category")).agg(F.count(F.lit(1)).alias("findings"))


def exit_code(findings: DataFrame, fail_on: int) -> DataFrame:
    """0 without findings, 2 if one reaches fail_on, else 1."""
    top = F.max("severity")
    return findings.agg(F.when(top.isNull(), 0).when(top >= fail_on, 2).otherwise(1).alias("code"), F.coalesce(top, F.lit(-1)).alias("max_severity"))


# ---- pairs ---------------------------------------------------------------------------------------------

# The two rules, the name of the pair, the largest distance in lines.
PAIRS = (
    ("aws_access_key_id", "aws_secret_access_key", "aws_credential_pair", 20),
    ("cloudflare_email", "cloudflare_api_key", "cloudflare_credential_pair", 10),
    ("github_app_id", "github_app_private_key", "github_app_credential_pair", 100),
    ("jwt", "jwt_signing_key", "jwt_key_pair", 20),
    ("oauth_client_id", "oauth_client_secret", "oauth_credential_pair", 20),
    ("stripe_secret_key", "stripe_publishable_key", "stripe_credential_pair", 50),
    ("twilio_account_sid", "twilio_auth_token", "twilio_credential_pair", 10),
)
DATABASE_URL = r"(?i)(postgres|postgresql|mysql|mongodb|redis|amqp)(\+\w+)?://[^:]+:[^@]+@"


def credential_pairs(findings: DataFrame, pairs=PAIRS) -> DataFrame:
    """Findings of two rules near each other in a file.

    A band join: lines are cut into bands as wide as the pair's span, so that path, pair and band make an
    equality, a hot file is dealt over its bands, and the distance is a filter on what is left."""
    names = ("rule_a", "rule_b", "pair", "span")
    kinds = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p, strict=True))) for p in pairs))
    specs = findings.sparkSession.range(1).select(F.inline(kinds))  # as many rows as kinds of pairs
    a = findings.select("path", F.col("line_no").alias("line_a"), F.col("rule").alias("rule_a"), F.col("secret").alias("secret_a")).join(F.broadcast(specs), "rule_a")
    b = findings.select(F.col("path"), F.col("line_no").alias("line_b"), F.col("rule").alias("rule_b"), F.col("secret").alias("secret_b"))
    b = b.join(F.broadcast(specs.select("rule_b", "pair", F.col("span").alias("span_b"))), "rule_b")
    band = F.floor(F.col("line_a") / (F.col("span") + 1))
    a = a.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    b = b.withColumn("band", F.floor(F.col("line_b") / (F.col("span_b") + 1)))
    near = a.drop("rule_b").join(b.drop("span_b"), ["path", "pair", "band"]).where(F.abs(F.col("line_a") - F.col("line_b")) <= F.col("span"))
    return near.select("path", "pair", "line_a", "line_b", "rule_a", "rule_b", "secret_a", "secret_b")


def database_urls(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("secret").rlike(to_java(DATABASE_URL))).select("path", F.lit("database_url_with_credentials").alias("pair"), "line_no", "rule", "secret")


# ---- confidence and feedback ---------------------------------------------------------------------------

# Rules whose modifier does not fall below -10.
HIGH_CERTAINTY = ("aws_access_key", "github_pat", "stripe_live_key", "private_key", "aws_secret_key", "github_oauth_token", "stripe_restricted")


def confidence_score(regex: Column, entropy: Column, keyword: Column, verified: Column, pair: Column, modifier: Column | None = None) -> Column:
    score = regex.cast("int") * 40 + (entropy >= 4.5).cast("int") * 20 + keyword.cast("int") * 15 + verified.cast("int") * 50 + pair.cast("int") * 30
    return score if modifier is None else F.least(F.greatest(score + modifier, F.lit(0)), F.lit(120))


def band(score: Column) -> Column:
    return F.when(score <= 30, "LOW").when(score <= 60, "MEDIUM").when(score <= 90, "HIGH").when(score <= 120, "CRITICAL").otherwise("VERY_HIGH")


def tier(samples: Column) -> Column:
    return F.when(samples >= 200, 3).when(samples >= 50, 2).when(samples >= 10, 1).otherwise(0)


def modifier(rule: Column, fp: Column, tp: Column, samples: Column) -> Column:
    """Smoothed with five verdicts each way, ramped up to 20 samples, between -40 and 40."""
    m = (1 - 2 * (fp + 5.0) / (fp + tp + 10.0)) * 40
    m = F.when(samples < 20, m * samples / 20.0).otherwise(m)
    m = F.when(rule.isin(*HIGH_CERTAINTY) & (m < -10), F.lit(-10.0)).otherwise(m)
    return F.when(samples == 0, F.lit(0.0)).otherwise(F.least(F.greatest(m, F.lit(-40.0)), F.lit(40.0)))


def learned_weights(verdicts: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Per rule and file pattern: decayed verdicts (by e in 90 days), samples, tier, modifier.

    verdicts: (fingerprint, verdict tp or fp, created_at); findings: (fingerprint, rule, path)."""
    from ..functions.text import file_pattern

    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    rows = verdicts.join(findings.where("rule != ''").select("fingerprint", "rule", "path"), "fingerprint")
    rows = rows.select("rule", file_pattern(F.col("path")).alias("file_pattern"), (F.col("verdict") == "fp").alias("fp"), F.exp(-age / 90.0).alias("w"))
    out = rows.groupBy("rule", "file_pattern").agg(
        F.sum(F.when(~F.col("fp"), F.col("w")).otherwise(0.0)).alias("tp_weighted"), F.sum(F.when(F.col("fp"), F.col("w")).otherwise(0.0)).alias("fp_weighted"),
        F.count(F.lit(1)).alias("samples"),
    )
    m = modifier(F.col("rule"), F.col("fp_weighted"), F.col("tp_weighted"), F.col("samples"))
    return out.withColumn("tier", tier(F.col("samples"))).withColumn("modifier", m)


def with_weights(findings: DataFrame, weights: DataFrame) -> DataFrame:
    from ..functions.text import file_pattern

    own = findings.withColumn("file_pattern", file_pattern(F.col("path")))
    out = own.join(weights.select("rule", "file_pattern", "modifier", "tier"), ["rule", "file_pattern"], "left")
    return out.withColumn("modifier", F.coalesce("modifier", F.lit(0.0))).withColumn("tier", F.coalesce("tier", F.lit(0)))


def rule_quality(judged: DataFrame, max_fp_rate: float = 0.005, max_fn_rate: float = 0.05) -> DataFrame:
    """Per rule from (rule, positive, hit): counts, precision, recall, false-positive rate and verdict."""
    tp = F.sum((F.col("positive") & F.col("hit")).cast("int"))
    fp = F.sum((~F.col("positive") & F.col("hit")).cast("int"))
    fn = F.sum((F.col("positive") & ~F.col("hit")).cast("int"))
    out = judged.groupBy("rule").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.sum((~F.col("positive")).cast("int")).alias("negatives"), F.sum(F.col("positive").cast("int")).alias("positives"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 4))

    out = out.select(
        "rule", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("fp"), F.col("negatives")).alias("fp_rate"), ratio(F.col("fn"), F.col("positives")).alias("fn_rate"),
    )
    return out.withColumn("passed", (F.col("fp_rate") <= max_fp_rate) & (F.col("fn_rate") <= max_fn_rate))
