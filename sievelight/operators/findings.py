"""Findings of the analysers, and the scan that runs everything over files or captured pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from . import decode, detect, post, scripts, surface, technology, trees
from .detect import as_findings
from .post import tech_band
from .rule_table import RULES, Rule



@dataclass(frozen=True)
class Scan:
    """What a scan does.  decoders: those whose texts are scanned again (none: no decoding), up to decode_depth layers,
    and only texts that are readable throughout if plain_pieces; min_endpoint_risk: least risk of an endpoint that
    counts; max_line: longer lines (in bytes) are left out by line detectors; media: random tokens count that begin
    like an image or font."""

    rules: tuple[Rule, ...] = RULES
    min_severity: int = 0
    strip_comments: bool = False
    max_line: int | None = None
    decoders: tuple[str, ...] = ("base64", "hex", "unicode", "url")
    rebuild_scripts: bool = True
    endpoints: bool = True
    min_endpoint_risk: int = 0
    technologies: bool = True
    media: bool = False
    decode_depth: int = decode.MAX_DEPTH
    plain_pieces: bool = False


def _plain(df: DataFrame, stage: int, method: str, **cols: Column) -> DataFrame:
    return as_findings(df, stage, method, 0, col=F.lit(0), entropy=F.lit(0.0), **cols)


def endpoint_findings(docs: DataFrame, min_risk: int = 0) -> DataFrame:
    found = surface.endpoints(docs).withColumn("risk", surface.risk(F.col("endpoint"))).where(F.col("risk") >= min_risk)
    return _plain(found, 13, "endpoint", rule=F.lit("endpoint"), severity=F.lit(0), secret=F.col("endpoint"), risk=F.col("risk"))


def package_findings(docs: DataFrame) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    found = surface.package_entries(docs).where("mutable or secret != ''")
    token = F.col("secret") != ""
    lower = F.lower(base)
    source = F.when(lower.isin("requirements.txt", "yarn.lock", "go.mod"), lower).when(lower == "cargo.toml", "Cargo.toml").otherwise(F.col("path"))
    return _plain(
        found, 14, "package", rule=F.when(token, "npm_auth_token").otherwise("mutable_dependency"), severity=F.when(token, 3).otherwise(1),
        secret=F.when(token, F.col("secret")).otherwise(F.col("name")), context=F.when(token, F.col("name")).otherwise(F.concat(F.lit("mutable "), source, F.lit(" dep in "), base)),
    )


def technology_findings(docs: DataFrame) -> DataFrame:
    found = technology.source_technologies(docs)
    return _plain(
        found, 15, "technology", line_no=F.lit(1), rule=F.concat(F.lit("tech_"), "category", F.lit("_"), "technology"), secret=F.col("technology"),
        context=F.concat("category", F.lit(": "), "technology"),
    )


def storage_findings(docs: DataFrame) -> DataFrame:
    found = surface.storage_references(docs)
    return _plain(
        found, 16, "storage", line_no=F.lit(1), rule=F.concat(F.lit("cloud_storage_"), "provider"), severity=F.lit(2), secret=F.col("url"),
        context=F.concat(F.lit("cloud storage reference: "), "url"),
    )


def surface_findings(docs: DataFrame, min_severity: int = 0) -> DataFrame:
    """Classes of a document's endpoints and, in scripts, of the calls that it makes."""
    ends = surface.endpoints(docs).select("path", F.col("endpoint").alias("url"), "line_no", "context")
    calls = scripts.requests(docs.where(scripts.is_script(F.col("path")) | F.lower("path").endswith(".vue"))).where("endpoint != ''")
    calls = calls.select("path", F.col("endpoint").alias("url")).join(ends.select("path", "url"), ["path", "url"], "left_anti").distinct()
    calls = calls.select("path", "url", F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("context"))
    urls = ends.unionByName(calls)
    found = urls.join(surface.classified(urls.select("url").distinct()), "url").where(F.col("severity") >= min_severity)
    context = F.coalesce("context", F.concat("category", F.lit(": "), "url"))
    return _plain(found, 17, "surface", rule=F.concat(F.lit("attack_surface_"), "category"), secret=F.col("url"), context=context)


def openapi_findings(specs: DataFrame, min_risk: int = 0) -> DataFrame:
    """Endpoints of captured specifications: contents whose address ends like one."""
    own = specs.where(F.col("path").rlike(r"\.(?:json|yaml|yml)\z"))
    found = trees.openapi_endpoints(own).withColumn("risk", surface.risk(F.col("endpoint"))).where(F.col("risk") >= min_risk)
    context = F.concat(F.lit("OpenAPI spec: "), "title", F.lit(" "), "version")
    return _plain(found, 18, "openapi", line_no=F.lit(1), rule=F.lit("openapi_endpoint"), severity=F.lit(2), secret=F.col("endpoint"), context=context, risk=F.col("risk"))


def response_findings(responses: DataFrame) -> DataFrame:
    """What captured responses tell: headers, technologies and gateways.  The code, technology or vendor is the secret."""
    headers = surface.header_findings(responses)
    headers = _plain(
        headers, 30, "headers", path=F.col("url"), line_no=F.lit(1), rule=F.lit("attack_surface_security-header"), secret=F.col("code"),
        context=F.concat(F.lit("security-header: "), "code"),
    )
    tech = technology.web_technologies(responses).select("origin", "technology", "category", "confidence", "severity")
    tech = as_findings(
        tech, 31, "technology", F.col("confidence"), path=F.col("origin"), line_no=F.lit(1), col=F.lit(0), entropy=F.lit(0.0),
        rule=F.concat(F.lit("tech_"), "category", F.lit("_"), "technology"), secret=F.col("technology"),
        context=F.concat("category", F.lit(": "), "origin", F.lit(" (confidence="), F.col("confidence").cast("string"), F.lit(", "), tech_band(F.col("confidence")), F.lit(")")),
    )
    fronts = surface.fronts(responses)
    fronts = _plain(
        fronts, 32, "gateway", path=F.col("url"), line_no=F.lit(1), rule=F.concat(F.lit("waf_"), "vendor"), severity=F.lit(0), secret=F.col("vendor"),
        context=F.concat(F.lit("gateway: "), "url"),
    )
    return headers.unionByName(tech).unionByName(fronts)


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0].select(*detect.FINDING)
    for p in parts[1:]:
        out = out.unionByName(p.select(*detect.FINDING))
    return out


def scan_content(docs: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    """Findings of the line detectors, of decoded pieces and of source technologies in (path, content)."""
    docs = docs.select("path", "content")
    parts = [detect.scan(docs, cfg.rules, cfg.min_severity, cfg.strip_comments, cfg.max_line, cfg.media)]
    if cfg.decoders:
        parts.append(decode.scan_decoded(docs, cfg.decoders, cfg.rules, cfg.min_severity, cfg.decode_depth, cfg.plain_pieces))
    if cfg.technologies:
        parts.append(technology_findings(docs))
    return _all(parts)


def scan_files(files: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    """All findings in files (path, content): contents, JSON files, rebuilt script text (whole), endpoints, manifests and the
    facts of script files.  What a path does not call for is left out before it is read."""
    docs = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    parts = [scan_content(docs, cfg), trees.json_findings(docs, cfg.rules, cfg.min_severity)]
    if cfg.rebuild_scripts:
        parts.append(trees.scan_rebuilt(docs, cfg.rules, cfg.min_severity, longest=None))
    if cfg.endpoints:
        parts += [endpoint_findings(docs, cfg.min_endpoint_risk), package_findings(docs)]
    parts.append(scripts.script_findings(docs))
    return _all(parts)


def scan_pages(captured: DataFrame, responses: DataFrame | None = None, cfg: Scan = Scan()) -> DataFrame:
    """All findings in captured pages (path: their address, content): contents, endpoints, storage, classes of what
    they lead to, specifications, source maps, and what responses tell."""
    from . import maps

    docs = captured.select("path", F.coalesce("content", F.lit("")).alias("content"))
    parts = [scan_content(docs, cfg)]
    if cfg.endpoints:
        parts.append(endpoint_findings(docs, cfg.min_endpoint_risk))
    parts += [storage_findings(docs), surface_findings(docs, cfg.min_severity), openapi_findings(docs, cfg.min_endpoint_risk)]
    parts.append(maps.source_map_findings(docs, docs, lambda inner: scan_content(inner, cfg)))
    if responses is not None:
        parts.append(response_findings(responses))
    return _all(parts)


def judged_scan(docs: DataFrame, cfg: Scan = Scan(), results: DataFrame | None = None) -> DataFrame:
    """Findings with confidence_band and verification_status: surfaces, rules (of any entropy), decoded pieces, random
    tokens as low findings, and credential pairs; judged, then downgraded, then each once.

    results: (secret, valid, state) of a verification, if there was one."""
    docs = docs.select("path", "content")
    tokens = detect.scan_entropy_tokens(docs, media=True)
    tokens = tokens.withColumn("rule", F.lit("entropy_token")).withColumn("severity", F.lit(1)).withColumn("entropy", E.shannon(F.col("secret")))
    parts = [surface_findings(docs, cfg.min_severity), detect.scan_rules(docs, cfg.rules, cfg.min_severity, 0.0), tokens]
    if cfg.decoders:
        parts.append(decode.scan_decoded(docs, cfg.decoders, cfg.rules, cfg.min_severity, cfg.decode_depth, cfg.plain_pieces))
    found = _all(parts)
    pairs = post.credential_pairs(found)
    span = F.abs(F.col("line_a") - F.col("line_b")).cast("string")
    pairs = _plain(
        pairs, 40, "pair", line_no=F.col("line_a"), rule=F.col("pair"), severity=F.lit(0), context=F.col("pair"),
        secret=F.concat("rule_a", F.lit(" + "), "rule_b", F.lit(" found within "), span, F.lit(" lines")),
    )
    every = found.unionByName(pairs)
    if results is None:
        every = every.withColumn("verification_status", F.lit(""))
    else:
        every = post.verification(every, results)
    entropy = F.when(F.col("entropy") == 0, E.shannon(F.col("secret"))).otherwise(F.col("entropy"))
    score = post.confidence_score(F.col("rule") != "entropy_token", entropy, F.lit(False), F.col("verification_status") == "VERIFIED", F.lit(False))
    return post.deduplicated(post.downgraded(every.withColumn("confidence_band", post.band(score))))
