"""Findings as files and messages: CSV, JSON, JSON lines, SARIF, Markdown, HTML, plain text, payloads.

What is written with write_* is whole and never passes through the driver.  Texts for people and messages are built on
the driver, from at most as many rows as the caller says (None: all)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_escaped, html_escaped, redacted
from ..operators.post import by_extension, by_risk, by_severity, category, for_display, scan_summary

# Columns of a report in order; names of severities; levels of the log format; names of categories.
COLUMNS = (
    "file", "line", "column", "rule", "severity", "risk_score", "secret", "entropy", "context", "confidence", "verification_status", "decoded_value_preview",
    "adaptive_modifier", "learning_tier",
)
SEVERITY_NAMES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SARIF_LEVELS = {4: "error", 3: "error", 2: "warning", 1: "note", 0: "note"}
CATEGORY_NAMES = (
    ("secrets", "Secrets & Credentials"), ("juicy_files", "Juicy Files Found"), ("endpoints", "Endpoints Discovered"), ("security_headers", "Security Headers"),
    ("internal_urls", "Internal URLs"), ("other", "Other Findings"),
)
#: Readers of the log format take so many results.
SARIF_RESULTS = 25_000


def hidden(findings: DataFrame) -> DataFrame:
    """Secrets redacted, in the context too."""
    short = redacted(F.col("secret"))
    return findings.withColumn("context", F.replace(F.col("context"), F.col("secret"), short)).withColumn("secret", short)


def severity_name(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITY_NAMES)), c)


def rows(findings: DataFrame, redact: bool = True) -> DataFrame:
    """The columns of a report; those that the findings lack are empty."""
    own = hidden(findings) if redact else findings
    has = set(own.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in has else F.lit("")

    modifier = F.coalesce(F.col("modifier").cast("int"), F.lit(0)) if "modifier" in has else F.lit(0)
    values = (
        F.col("path"), F.col("line_no"), F.col("col"), F.col("rule"), severity_name(F.col("severity")), F.col("risk") if "risk" in has else F.lit(0), F.col("secret"),
        F.format_string("%.3f", F.coalesce(F.col("entropy"), F.lit(0.0))), F.col("context"), text("confidence_band"), text("verification_status"), text("decoded_value_preview"),
        modifier, text("learning_tier"),
    )
    return own.select(*(v.alias(c) for v, c in zip(values, COLUMNS, strict=True)))


def csv_lines(findings: DataFrame, redact: bool = True) -> DataFrame:
    """(value): a line per finding."""
    return rows(findings, redact).select(F.concat_ws(",", *(csv_escaped(F.col(c).cast("string")) for c in COLUMNS)).alias("value"))


def write_csv(findings: DataFrame, path: str, redact: bool = True) -> None:
    out = rows(findings, redact).write.option("header", "true").option("escape", '"').option("emptyValue", "")
    out.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def _without_empty(df: DataFrame) -> DataFrame:
    """Empty texts and zero scores as null, which the writer leaves out."""
    always = {"file", "line", "column", "rule", "severity", "secret", "context", "entropy"}
    cols = []
    for c, t in df.dtypes:
        zero = F.lit("") if t == "string" else F.lit(0)
        cols.append(F.col(c) if c in always else F.when(F.col(c) != zero, F.col(c)).alias(c))
    return df.select(*cols)


def _objects(findings: DataFrame, redact: bool) -> DataFrame:
    own = rows(findings, redact)
    return _without_empty(own.withColumn("entropy", F.col("entropy").cast("double")))


def write_jsonl(findings: DataFrame, path: str, redact: bool = True) -> None:
    """A JSON object a line; empty texts are left out."""
    _objects(findings, redact).write.json(path)


def summary(findings: DataFrame) -> dict:
    """Counts of a scan: by severity, kind of file and risk, and of endpoints."""
    one = scan_summary(findings).first()
    return {
        "files_with_findings": one["files"], "total_findings": one["findings"],
        "by_severity": {SEVERITY_NAMES[r["severity"]]: r["findings"] for r in by_severity(findings).orderBy(F.desc("severity")).collect()},
        "file_type_counts": {r["ext"]: r["findings"] for r in by_extension(findings).orderBy("ext").collect()},
        "risk_score_distribution": {str(r["risk"]): r["findings"] for r in by_risk(findings).orderBy("risk").collect()},
        "endpoint_count": one["endpoints"],
    }


def _in_order(findings: DataFrame, most: int | None) -> DataFrame:
    out = findings.orderBy(F.desc("severity"), "path", "line_no", "col", "rule", "secret")
    return out if most is None else out.limit(most)


def json_report(findings: DataFrame, most: int | None = None, redact: bool = True) -> str:
    """Findings, the gravest first, and the summary of all."""
    texts = _in_order(findings, most)
    own = _objects(texts, redact).select(F.to_json(F.struct("*")).alias("j")).collect()
    return json.dumps({"findings": [json.loads(r["j"]) for r in own], "summary": summary(findings)}, ensure_ascii=False, indent=2)


def write_json(findings: DataFrame, path: str, redact: bool = True) -> None:
    """findings/ with a JSON object a line, and summary/ with one."""
    write_jsonl(findings, f"{path}/findings", redact)
    spark = findings.sparkSession
    spark.range(1).select(F.lit(json.dumps(summary(findings))).alias("value")).write.text(f"{path}/summary")


def sarif(findings: DataFrame, most: int | None = SARIF_RESULTS) -> str:
    """A SARIF 2.1.0 log of the gravest findings."""
    found = hidden(_in_order(findings, most)).collect()
    index = {r: i for i, r in enumerate(dict.fromkeys(x["rule"] for x in found))}
    results = [
        {
            "ruleId": x["rule"], "ruleIndex": index[x["rule"]], "level": SARIF_LEVELS[x["severity"]], "message": {"text": f"{x['rule']}: {x['secret']}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": x["path"]}, "region": {"startLine": max(1, x["line_no"]), "startColumn": x["col"] + 1}}}],
        }
        for x in found
    ]
    run = {"tool": {"driver": {"name": "sievelight", "rules": [{"id": r} for r in index]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


# ---- reports for people --------------------------------------------------------------------------------


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _lines(spark, part: int, texts: list[str]) -> DataFrame:
    """Fixed lines of a report."""
    each = spark.range(1).select(F.posexplode(F.array(*map(F.lit, texts))).alias("n", "value"))
    return each.select(F.lit(part).alias("part"), F.lit("").alias("file"), F.lit(0).alias("section"), F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit("").alias("c")).alias("at"), "value")


def _block(df: DataFrame, part: int, section: int, value: Column, file: Column, at: tuple[Column, Column, Column]) -> DataFrame:
    place = F.struct(at[0].cast("int").alias("a"), at[1].cast("int").alias("b"), at[2].alias("c"))
    return df.select(F.lit(part).alias("part"), file.alias("file"), F.lit(section).alias("section"), place.alias("at"), value.alias("value"))


def _totals(findings: DataFrame, part: int, line) -> DataFrame:
    own = by_severity(findings).withColumn("name", severity_name(F.col("severity")))
    return _block(own, part, 0, line(F.col("name"), F.col("findings")), F.lit(""), (-F.col("severity"), F.lit(0), F.lit("")))


def _by_file(findings: DataFrame, head, row, foot: str | None = None) -> list[DataFrame]:
    """A section for each file: lines of its head, a line for each finding, maybe a last line."""
    own = rows(findings, False).withColumn("sev", F.array_position(F.array(*map(F.lit, SEVERITY_NAMES)), F.col("severity")))
    files = own.select("file").distinct()
    none = (F.lit(0), F.lit(0), F.lit(""))
    parts = [_block(files, 1, k, line(F.col("file")), F.col("file"), none) for k, line in enumerate(head)]
    parts.append(_block(own, 1, len(head), row(own), F.col("file"), (-F.col("sev"), F.col("line"), F.concat_ws(" ", "rule", "secret"))))
    if foot is not None:
        parts.append(_block(files, 1, len(head) + 1, F.lit(foot), F.col("file"), none))
    return parts


def markdown_lines(findings: DataFrame, redact: bool = True) -> DataFrame:
    own = hidden(findings) if redact else findings
    spark = findings.sparkSession
    one = scan_summary(findings)
    adapt = F.when(F.col("adaptive_modifier") != 0, F.format_string("%+d", F.col("adaptive_modifier"))).otherwise("")
    tier = F.when(F.col("adaptive_modifier") != 0, F.col("learning_tier")).otherwise("")
    head = (
        lambda f: _say("## `", f, "`"), lambda f: F.lit(""), lambda f: F.lit("| Line | Severity | Risk | Confidence | Verification | Rule | Entropy | Adapt | Tier | Secret |"),
        lambda f: F.lit("|------|----------|------|------------|--------------|------|---------|-------|------|--------|"),
    )

    def row(r: DataFrame) -> Column:
        cells = ["line", "severity", "risk_score", "confidence", "verification_status"]
        return _say("| ", F.concat_ws(" | ", *(F.col(c).cast("string") for c in cells), _say("`", F.col("rule"), "`"), F.col("entropy"), adapt, tier, _say("`", F.col("secret"), "`")), " |")

    parts = [_lines(spark, 0, ["# Scan results", ""]), *_by_file(own, head, row, ""), _lines(spark, 2, ["## Summary", ""])]
    zero = (F.lit(0), F.lit(0), F.lit(""))
    parts.append(_block(one, 3, 0, _say("- **Files with findings:** ", F.col("files")), F.lit(""), zero))
    parts.append(_block(one, 4, 0, _say("- **Total findings:** ", F.col("findings")), F.lit(""), zero))
    parts += [_lines(spark, 5, ["", "| Severity | Count |", "|----------|-------|"]), _totals(findings, 6, lambda s, n: _say("| ", s, " | ", n, " |"))]
    return _joined(parts)


def html_lines(findings: DataFrame, redact: bool = True) -> DataFrame:
    own = hidden(findings) if redact else findings
    spark = findings.sparkSession
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3em;text-align:left}.secret{font-family:monospace;word-break:break-all}"
    head = [
        "<!DOCTYPE html>", '<html lang="en"><head><meta charset="UTF-8"><title>Scan results</title>', f"<style>{style}</style></head><body>", "<h1>Scan results</h1>",
        *([] if redact else ["<p>Secrets are shown in full: do not share this page.</p>"]),
    ]
    table = (
        lambda f: _say("<h2>", html_escaped(f), "</h2>"),
        lambda f: F.lit("<table><tr><th>Line</th><th>Severity</th><th>Risk</th><th>Confidence</th><th>Verification</th><th>Rule</th><th>Entropy</th><th>Secret</th></tr>"),
    )

    def row(r: DataFrame) -> Column:
        cells = ["line", "severity", "risk_score", "confidence", "verification_status", "rule", "entropy"]
        return _say("<tr>", *(_say("<td>", html_escaped(F.col(c).cast("string")), "</td>") for c in cells), '<td class="secret">', html_escaped(F.col("secret")), "</td></tr>")

    parts = [_lines(spark, 0, head), *_by_file(own, table, row, "</table>")]
    zero = (F.lit(0), F.lit(0), F.lit(""))
    parts.append(_block(scan_summary(findings), 2, 0, _say("<h2>Summary</h2><p>Files with findings: ", F.col("files"), "<br>Total findings: ", F.col("findings"), "</p><ul>"), F.lit(""), zero))
    parts += [_totals(findings, 3, lambda s, n: _say("<li>", s, ": ", n, "</li>")), _lines(spark, 4, ["</ul></body></html>"])]
    return _joined(parts)


def text_lines(findings: DataFrame, redact: bool = True) -> DataFrame:
    """Findings by category, each path and secret once."""
    once = for_display(findings)
    own = (hidden(once) if redact else once).withColumn("category", category(F.col("rule")))
    spark = findings.sparkSession
    place = F.lit(0)
    name = F.lit("")
    for k, (c, label) in enumerate(CATEGORY_NAMES):
        place, name = F.when(F.col("category") == c, k).otherwise(place), F.when(F.col("category") == c, label).otherwise(name)
    count = own.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("k", place).withColumn("label", name)
    zero = (F.lit(0), F.lit(0), F.lit(""))

    def cut(c: Column, n: int) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)

    mark = F.when(F.col("risk") >= 8, " [!+]").when(F.col("risk") >= 5, " [!]").otherwise("")
    line = F.concat(F.format_string("  %-8s ", severity_name(F.col("severity"))), cut(F.col("secret"), 60), mark)
    context = F.when((F.col("context") != "") & (F.col("context") != cut(F.col("secret"), 60)), _say("\n    ", cut(F.col("context"), 70))).otherwise("")
    file = F.format_string("%02d", place)
    parts = [
        _lines(spark, 0, ["Quick summary"]), _block(count, 1, 0, F.format_string("  %-24s %d", F.concat("label", F.lit(":")), F.col("n")), F.format_string("%02d", F.col("k")), zero),
        _block(count, 2, 0, F.format_string("\n%s (%d)", F.col("label"), F.col("n")), F.format_string("%02d", F.col("k")), zero),
        _block(own, 2, 1, F.concat(line, context), file, (-F.col("severity"), F.col("line_no"), F.concat_ws(" ", "path", "secret"))),
        _block(scan_summary(once), 3, 0, _say("\nTotal findings: ", F.col("findings")), F.lit(""), zero), _totals(once, 4, lambda s, n: F.format_string("  %-10s %d", s, n)),
    ]
    return _joined(parts)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """(value): the parts' lines in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("part", "file", "section", "at").select("value")


LINES = {"markdown": markdown_lines, "html": html_lines, "text": text_lines, "csv": csv_lines}


def write_report(findings: DataFrame, path: str, kind: str, redact: bool = True) -> None:
    """A whole report as text files in order (a file for each range of lines)."""
    LINES[kind](findings, redact).write.text(path)


def rendered(findings: DataFrame, kind: str, most: int | None = 1000, redact: bool = True) -> str:
    """A report of at most so many findings, the gravest, as one text."""
    own = findings if most is None else _in_order(findings, most)
    out = [r["value"] for r in LINES[kind](own, redact).collect()]
    return "\n".join([",".join(COLUMNS), *out] if kind == "csv" else out)


def markdown(findings: DataFrame, most: int | None = 1000) -> str:
    return rendered(findings, "markdown", most)


def top_payload(findings: DataFrame, most: int = 10, style: str = "slack") -> str:
    """The gravest findings and how many there are, as the body of a message: slack, discord or json."""
    if style == "json":
        return json.dumps({"summary": summary(findings), "findings": json.loads(json_report(findings, most))["findings"], "source": "sievelight"})
    top = hidden(_in_order(findings, most)).collect()
    count = findings.count()
    if style == "discord":
        embeds = []
        for x in top:
            text = f"{x['rule']}\n{x['context']}"
            embeds.append({"title": f"[{SEVERITY_NAMES[x['severity']]}] {x['rule']}", "description": text if len(text) <= 4096 else text[:4093] + "...", "color": 0xE74C3C})
        return json.dumps({"content": f"**Scan results**: {count} finding(s)", "embeds": embeds})
    lines = [f"*Scan results*: {count} finding(s)", *(f"• [{SEVERITY_NAMES[x['severity']]}] {x['rule']}: {x['secret']} in {x['path']}:{x['line_no']}" for x in top)]
    if count > len(top):
        lines.append(f"... and {count - len(top)} more")
    return json.dumps({"text": "\n".join(lines), "mrkdwn": True})
