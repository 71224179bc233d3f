"""What outlives a run: fetched addresses, verdicts, learned weights; and what is told from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the tiers of learned weights, from the lowest.
TIERS = ("Experimental", "Learning", "Mature", "Trusted")


def short_hash(c: Column) -> Column:
    """16 bytes of SHA-256 in hex: of addresses and of contents."""
    return F.substring(F.sha2(c, 256), 1, 32)


def recorded_urls(cache: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """The cache (url_hash, url, status, content_hash, first_seen, last_seen) after fetches (url, status, content).

    A known address gets the new status and content hash; of several fetches of one the last by status and content
    counts."""
    fresh = fetched.select(short_hash(F.col("url")).alias("url_hash"), F.col("url").alias("u"), F.col("status").alias("s"), short_hash(F.coalesce("content", F.lit(""))).alias("h"))
    fresh = fresh.groupBy("url_hash").agg(F.max(F.struct("s", "h", "u")).alias("v"))
    both = cache.join(fresh, "url_hash", "full_outer")
    hit = F.col("v").isNotNull()
    return both.select(
        "url_hash", F.coalesce("url", "v.u").alias("url"), F.when(hit, F.col("v.s")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("v.h")).otherwise(F.col("content_hash")).alias("content_hash"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def unseen(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Addresses (url) that were not fetched with success before."""
    return urls.join(cache.where("status = 200").select("url").distinct(), "url", "left_anti")


def changed(fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """Fetches (url, status, content) whose content is not the one in the cache."""
    known = cache.where("status = 200").select("url", F.col("content_hash").alias("_known"))
    out = fetched.join(known, "url", "left").where(~F.col("_known").eqNullSafe(short_hash(F.coalesce("content", F.lit("")))))
    return out.select(*fetched.columns)


def checked_verdicts(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """verdicts (fingerprint, verdict, created_at) with the column problem: null for those to append, else why not."""
    known = findings.select("fingerprint", F.lit(True).alias("_known")).distinct()
    out = verdicts.join(known, "fingerprint", "left")
    problem = F.when(~F.coalesce(F.col("verdict").isin("tp", "fp"), F.lit(False)), "verdict must be tp or fp").when(F.col("_known").isNull(), "unknown fingerprint")
    return out.select(*verdicts.columns, problem.alias("problem"))


def append_verdicts(verdicts: DataFrame, findings: DataFrame, path: str) -> DataFrame:
    """Appends the good verdicts to the log at path (Parquet); returns the others with their problem."""
    out = checked_verdicts(verdicts, findings)
    out.where("problem is null").drop("problem").write.mode("append").parquet(path)
    return out.where("problem is not null")


def weights_report(weights: DataFrame) -> DataFrame:
    """Learned weights as a report, the strongest modifier first: whole verdict counts, the smoothed share of false
    positives, and the tier's name."""
    share = (F.col("fp_weighted") + 5.0) / (F.col("fp_weighted") + F.col("tp_weighted") + 10.0)
    tier = F.coalesce(F.get(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit("Unknown"))
    out = weights.select(
        "rule", "file_pattern", F.col("tp_weighted").cast("int").alias("tp"), F.col("fp_weighted").cast("int").alias("fp"), share.alias("fp_ratio"), "modifier", tier.alias("tier")
    )
    return out.orderBy(F.desc(F.abs("modifier")), "rule", "file_pattern")


def counts(verdicts: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: number of verdicts, of cached addresses, and of those fetched with success."""
    v = verdicts.agg(F.count(F.lit(1)).alias("verdicts"))
    u = urls.agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("status") == 200).alias("seen"))
    return v.select("verdicts", F.lit(1).alias("_k")).join(u.withColumn("_k", F.lit(1)), "_k").drop("_k")


def on_live_hosts(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Addresses (url) whose host is among the live hosts (host)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    live = hosts.select(F.lower("host").alias("_host")).distinct()
    return urls.withColumn("_host", host).join(live, "_host", "left_semi").select(*urls.columns)


def not_found_before(findings: DataFrame, others: DataFrame, length: int = 60) -> DataFrame:
    """Findings without those whose secret's first characters a finding of the others has in the same file."""
    key = F.substring("secret", 1, length)
    seen = others.select("path", key.alias("_key")).distinct()
    return findings.withColumn("_key", key).join(seen, ["path", "_key"], "left_anti").select(*findings.columns)
