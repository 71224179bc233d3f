"""Line detectors: each takes (path, content) and gives findings.

Findings have the columns path, line_no, col, rule, severity, secret, context, entropy, confidence, method,
stage_ord (order of the detectors, for deduplication) and risk (of endpoints; else 0)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions.regex import compiled, to_java
from ..functions.text import SHORT_CONTEXT, lines, trimmed, truncated
from .matching import edges, guard, line_matches
from .rule_table import RULES, Rule

SEVERITIES = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
MIN_ENTROPY = 2.0
FINDING = ["path", "line_no", "col", "rule", "severity", "secret", "context", "entropy", "confidence", "method", "stage_ord", "risk"]


def severity_of(name: str, strict: bool = True) -> int:
    """Names in other than capitals are LOW (as rules in use rely on it) unless strict is off."""
    return SEVERITIES.get(name if strict else name.upper(), 1)


def severity_at(rules: Sequence[Rule], ord_: Column) -> Column:
    """The severity of the rule of that number: a constant array, so nothing is joined."""
    return F.get(F.array(*(F.lit(severity_of(r.severity)) for r in rules)), ord_)


def context_gate(rules: Sequence[Rule], name: Column, line: Column) -> Column:
    """Whether a line has one of the keywords that a rule asks for."""
    low, out = F.lower(line), F.lit(True)
    for r in rules:
        if r.requires_context:
            some = F.lit(False)
            for k in r.context_keywords:
                some = some | low.contains(k)
            out = F.when(name == r.name, some).otherwise(out)
    return out


def as_findings(df: DataFrame, stage: int, method: str, confidence: int | Column, **cols: Column) -> DataFrame:
    """Rows as findings; columns that are not given are df's own."""
    own = {"method": F.lit(method), "confidence": F.lit(confidence), "stage_ord": F.lit(stage), "risk": F.lit(0)} | cols
    return df.select(*(own[c].alias(c) if c in own else F.col(c) for c in FINDING))


def scan_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, min_severity: int = 0, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """Regular-expression rules over each line; the secret is the whole match."""
    rules = [r for r in rules if severity_of(r.severity) >= min_severity]
    found = line_matches(docs.select("path", "content"), [(r.name, r.pattern) for r in rules])
    found = found.select("path", "line_no", "line", "col", F.col("name").alias("rule"), severity_at(rules, F.col("ord")).alias("severity"), F.col("value").alias("secret"))
    found = found.where(context_gate(rules, F.col("rule"), F.col("line"))).withColumn("entropy", E.shannon(F.col("secret"))).where(F.col("entropy") >= min_entropy)
    return as_findings(found, 1, "regex", 60, context=truncated(trimmed(F.col("line"))))


def _window_ends(lines: list[str], pattern: str, window: int) -> list[int]:
    """Last lines (from 1) of the windows that may be the first to have a match.

    A match that begins and ends with a literal is new where its last line comes in, or where a line with an earlier
    beginning goes out.  Of other patterns all windows count that have a line with one of their literals."""
    first, last = edges(pattern)
    n = len(lines)
    if first and last:
        ends = {max(2, i + 1) for i, x in enumerate(lines) if last in x}
        ends |= {i + window + 1 for i, x in enumerate(lines) if first in x}
        return sorted(e for e in ends if e <= n)
    own = guard(pattern)
    hits = [i for i, x in enumerate(lines) if any(v in (x.lower() if own.fold else x) for v in own.literals)] if own.literals else range(n)
    return sorted({e for i in hits for e in range(max(2, i + 1), min(n, i + window) + 1)})


def scan_multiline(docs: DataFrame, rules: Sequence[Rule] = RULES, window: int = 100, min_severity: int = 0) -> DataFrame:
    """Multi-line rules over windows of up to `window` lines that end at each line from the second on; a
    value counts at the first window that has it.  A value may span at most the window."""
    rules = [r for r in rules if r.multi_line and severity_of(r.severity) >= min_severity]

    def found(path: str, text: str) -> list[tuple]:
        low = text.lower()
        live = [r for r in rules if not (g := guard(r.pattern)).literals or any(x in (low if g.fold else text) for x in g.literals)]
        if not live or "\n" not in text:
            return []
        ls = text.split("\n")
        first: dict[tuple[str, str], tuple] = {}
        for r in live:
            for end in _window_ends(ls, r.pattern, window):
                start = max(0, end - window)
                joined = "\n".join(ls[start:end])
                for m in compiled(r.pattern).finditer(joined):
                    key = (m.group(), r.name)
                    if key not in first:
                        at = len(joined[: m.start()].encode())
                        first[key] = (path, start + 1, at, r.name + "_multiline", severity_of(r.severity), m.group(), joined[:SHORT_CONTEXT])
        return list(first.values())

    def run(batches):
        for b in batches:
            out = [x for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in found(path, text or "")]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "line_no", "col", "rule", "severity", "secret", "context"])

    found_ = docs.select("path", "content").mapInArrow(run, "path string, line_no int, col int, rule string, severity int, secret string, context string")
    return as_findings(found_, 6, "multiline_regex", 60, entropy=E.shannon(F.col("secret")))


def _tokens(docs: DataFrame, gate) -> DataFrame:
    each = lines(docs.select("path", "content")).where(gate(F.col("line")))
    each = each.withColumn("secret", F.explode(F.regexp_extract_all("line", F.lit(to_java(E.TOKEN)), F.lit(0))))
    return each.withColumn("col", _before(F.col("line"), F.col("secret")))


def _before(line: Column, token: Column) -> Column:
    """Bytes of a line before a token's first occurrence."""
    return F.octet_length(F.substring(line, F.lit(1), F.position(token, line) - 1)).cast("int")


def scan_entropy_tokens(docs: DataFrame, media: bool = False) -> DataFrame:
    """Random-looking tokens in lines that speak of secrets; beginnings of images and fonts count if media."""
    tok = _tokens(docs, E.secret_context)
    s = F.col("secret")
    tok = tok.where(E.token_match(s) if media else E.token_match(s) & ~E.media(s))
    return as_findings(tok, 2, "entropy+context", 30, rule=F.lit("high_entropy_token"), severity=F.lit(2), entropy=E.by_alphabet(s), context=truncated(trimmed(F.col("line"))))


def _contextual(line: Column, token: Column, min_entropy: float, media: bool = False) -> Column:
    """Whether a token is random enough, neither in a path nor after / : or @, and, unless media, no image or font."""
    at = F.position(token, line)
    after_mark = (at > 1) & F.substring(line, at - 1, F.lit(1)).isin("/", ":", "@")
    slashes = F.length(token) - F.length(F.replace(token, F.lit("/"), F.lit("")))
    good = (E.shannon(token) >= min_entropy) & ~after_mark & (slashes < 2)
    return good if media else good & ~E.media(token)


def scan_contextual(docs: DataFrame, min_entropy: float = 4.5, media: bool = False) -> DataFrame:
    """High-entropy tokens next to a keyword, neither in a path nor after / : or @; beginnings of images and fonts count
    if media."""
    s = F.col("secret")
    tok = _tokens(docs, E.context_keyword).where(_contextual(F.col("line"), s, min_entropy, media))
    return as_findings(tok, 3, "entropy+context", 30, rule=F.lit("contextual_entropy_secret"), severity=F.lit(3), entropy=E.shannon(s), context=truncated(trimmed(F.col("line"))))


# Rule, severity, pattern; the secret is group 1 of a line's first match.
AUTH_HEADERS = (
    ("bearer_token_hardcoded", 3, r"""(?i)(?:Authorization|X-Auth-Token|X-Auth-Key)[\s:=]+['"]?(?:Bearer\s+)?([A-Za-z0-9\-_.+/=]{20,})['"]?"""),
    ("basic_auth_hardcoded", 4, r"(?i)Authorization:\s*Basic\s+([A-Za-z0-9+/=]{10,})"),
    ("api_key_header_hardcoded", 3, r"""(?i)(?:X-)?API(?:Key|_Key|-Key)\s*[:=]\s*['"]?([A-Za-z0-9_\-+!@#$%^&*()=]{16,})['"]?"""),
    ("auth_token_header_hardcoded", 3, r"""(?i)(?:X-)?Auth(?:Token|_Token|-Token)\s*[:=]\s*['"]?([A-Za-z0-9_\-]{16,})['"]?"""),
)
# Query parameters that carry secrets.
URL_PARAMETERS = ("access_token", "token", "api_key", "auth", "jwt", "bearer", "key", "secret")
URL_SECRET = r"""https?://[^\s"'<>?#]+\?(?:[^\s"'<>#]*?&)?(?:access_token|token|api_key|auth|jwt|bearer|key|secret)=([^&\s"'<>#]+)"""


def scan_auth_headers(docs: DataFrame) -> DataFrame:
    """Credentials in header lines."""
    each = lines(docs.select("path", "content"))
    hits = F.array(*(
        F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"), F.when(F.col("line").rlike(to_java(p)), F.regexp_extract("line", to_java(p), 1)).alias("secret"))
        for name, sev, p in AUTH_HEADERS
    ))
    found = each.select("path", "line_no", "line", F.explode(F.filter(hits, lambda h: h["secret"].isNotNull())).alias("h")).select("path", "line_no", "line", "h.*")
    return as_findings(found, 4, "auth_header", 60, col=F.lit(0), entropy=E.shannon(F.col("secret")), context=truncated(F.col("line")))


def scan_url_secrets(docs: DataFrame) -> DataFrame:
    """Values of telling query parameters, the first of each URL."""
    each = lines(docs.select("path", "content")).where(F.col("line").rlike(to_java(URL_SECRET)))
    found = each.withColumn("secret", F.explode(F.regexp_extract_all("line", F.lit(to_java(URL_SECRET)), F.lit(1))))
    return as_findings(found, 5, "url_param", 70, col=F.lit(0), rule=F.lit("url_query_secret"), severity=F.lit(3), entropy=E.shannon(F.col("secret")), context=truncated(trimmed(F.col("line"))))


def scan_lines(docs: DataFrame, media: bool = False) -> DataFrame:
    """What scan_entropy_tokens, scan_contextual, scan_auth_headers and scan_url_secrets find, in one pass over the lines."""
    line = F.col("line")

    def found(rule, severity, secret: Column, col: Column, entropy: Column, confidence: int, context: Column, method: str, stage: int) -> Column:
        values = (rule, severity, secret, col, entropy, confidence, context, method, stage)
        names = ("rule", "severity", "secret", "col", "entropy", "confidence", "context", "method", "stage_ord")
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, names, strict=True)))

    shown = truncated(trimmed(line))
    tokens = F.regexp_extract_all(line, F.lit(to_java(E.TOKEN)), F.lit(0))
    random_ = F.transform(
        F.filter(tokens, lambda s: E.token_match(s) if media else E.token_match(s) & ~E.media(s)),
        lambda s: found("high_entropy_token", 2, s, _before(line, s), E.by_alphabet(s), 30, shown, "entropy+context", 2),
    )
    near = F.transform(
        F.filter(tokens, lambda s: _contextual(line, s, 4.5, media)),
        lambda s: found("contextual_entropy_secret", 3, s, _before(line, s), E.shannon(s), 30, shown, "entropy+context", 3),
    )
    none = F.filter(F.array(found("", 0, F.lit(""), F.lit(0), F.lit(0.0), 0, F.lit(""), "", 0)), lambda x: F.lit(False))
    heads = F.filter(
        F.array(*(
            F.when(line.rlike(to_java(p)), found(name, sev, F.regexp_extract(line, to_java(p), 1), F.lit(0), E.shannon(F.regexp_extract(line, to_java(p), 1)), 60, truncated(line), "auth_header", 4))
            for name, sev, p in AUTH_HEADERS
        )),
        lambda h: h.isNotNull(),
    )
    urls = F.transform(
        F.regexp_extract_all(line, F.lit(to_java(URL_SECRET)), F.lit(1)), lambda s: found("url_query_secret", 3, s, F.lit(0), E.shannon(s), 70, shown, "url_param", 5)
    )
    every = F.concat(
        F.when(E.secret_context(line), random_).otherwise(none), F.when(E.context_keyword(line), near).otherwise(none), heads, F.when(line.contains("://"), urls).otherwise(none),
    )
    each = lines(docs.select("path", "content")).select("path", "line_no", F.explode(every).alias("f")).select("path", "line_no", "f.*")
    return each.withColumn("risk", F.lit(0)).select(*FINDING)


def scan(
    docs: DataFrame, rules: Sequence[Rule] = RULES, min_severity: int = 0, strip_comments: bool = False, max_line: int | None = None, media: bool = False,
) -> DataFrame:
    """All line detectors over (path, content)."""
    from ..functions.text import without_comments

    if strip_comments:
        docs = docs.withColumn("content", without_comments(F.col("content")))
    if max_line:
        parts = F.split("content", "\n", -1)
        docs = docs.withColumn("content", F.array_join(F.transform(parts, lambda x: F.when(F.octet_length(x) <= max_line, x).otherwise("")), "\n"))
    out = scan_rules(docs, rules, min_severity).unionByName(scan_lines(docs, media))
    return out.unionByName(scan_multiline(docs, rules, min_severity=min_severity))
