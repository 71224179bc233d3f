"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import entropy as E
from ..operators import post, scripts, surface, technology, trees
from ..operators.detect import AUTH_HEADERS, URL_SECRET, severity_of
from ..operators.rule_table import RULES
from ..sources.corpora import SQL as CORPORA
from .fixtures import quoted

WHITE = r"[\s\x{0B}\x{85}\x{A0}]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def entropy(c: str) -> str:
    one = f"((length({c}) - length(replace({c}, x, ''))) / length({c})::DOUBLE)"
    return (
        f"CASE WHEN {c} = '' THEN 0.0 ELSE round(-list_sum(list_transform(list_sort(list_distinct(string_split({c}, ''))), "
        f"lambda x: {one} * log2({one}))), 3) END"
    )


def lines(corpus: str) -> str:
    return (
        f"corpus AS ({CORPORA[corpus]}), lines AS (SELECT path, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line "
        "FROM (SELECT path, string_split(coalesce(content, ''), chr(10)) AS parts FROM corpus))"
    )


def matches(rules=RULES) -> str:
    """CTE hits (path, line_no, line, ord, rule, severity, secret)."""
    parts = []
    for i, r in enumerate(rules):
        gate = " OR ".join(f"contains(lower(line), {quoted(k)})" for k in r.context_keywords) if r.requires_context else ""
        parts.append(
            f"SELECT path, line_no, line, {i} AS ord, {quoted(r.name)} AS rule, {severity_of(r.severity)} AS severity, "
            f"unnest(regexp_extract_all(line, {quoted(r.pattern)}, 0)) AS secret FROM lines WHERE regexp_matches(line, {quoted(r.pattern)})" + (f" AND ({gate})" if gate else "")
        )
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def findings(corpus: str) -> str:
    """WITH ... findings (path, line_no, line, rule, severity, secret, context, entropy, ord)."""
    return (
        f"WITH {lines(corpus)}, {matches()}, findings AS (SELECT *, left({trimmed('line')}, 500) AS context FROM "
        f"(SELECT *, {entropy('secret')} AS entropy FROM hits) WHERE entropy >= 2.0)"
    )


def deduplicated(corpus: str) -> str:
    return findings(corpus) + (
        ", unique_findings AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY rule, secret, path, left(context, 40) ORDER BY line_no) = 1)"
    )


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"


def rules_query(corpus: str) -> str:
    return findings(corpus) + " SELECT path, line_no, rule, severity, secret, context, entropy FROM findings"


def tokens(corpus: str, gate: str) -> str:
    return f"WITH {lines(corpus)}, tok AS (SELECT path, line_no, line, unnest(regexp_extract_all(line, {quoted(E.TOKEN)}, 0)) AS secret FROM lines WHERE {gate})"


def alphabet(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '[-_]') AND regexp_full_match({c}, '[0-9A-Za-z_-]+') THEN CASE WHEN contains({c}, '-') AND contains({c}, '_') THEN 'jwt' ELSE 'base64url' END "
        f"WHEN regexp_full_match({c}, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match({c}, '[0-9A-Za-z]*=+') THEN 'base64' ELSE 'unknown' END"
    )


def likely(c: str) -> str:
    kinds = " + ".join(f"regexp_matches({c}, {quoted(p)})::INT" for p in ("[a-z]", "[A-Z]", "[0-9]", r"[+/=_\-@$!%^&*()]"))
    return f"(length({c}) >= 32 AND NOT regexp_full_match({c}, '[0-9]*') AND ({kinds}) >= 3 AND {entropy(c)} >= 4.5)"


def entropy_tokens(corpus: str, columns: str = "path, line_no, secret, entropy") -> str:
    a = alphabet("secret")
    return tokens(corpus, f"regexp_matches(line, {quoted(E.SECRET_CONTEXT)})") + (
        f", t AS (SELECT *, {a} AS a, {entropy('secret')} AS entropy FROM tok) SELECT {columns} FROM t "
        f"WHERE NOT regexp_matches(secret, {quoted(E.EXCLUDED)}) AND CASE a WHEN 'unknown' THEN {likely('secret')} WHEN 'hex' THEN entropy >= 3.0 ELSE entropy >= 4.0 END"
    )


def contextual(corpus: str, columns: str = "path, line_no, secret, entropy") -> str:
    gate = "(" + " OR ".join(f"contains(lower(line), {quoted(k)})" for k in E.CONTEXT_KEYWORDS) + ")"
    return tokens(corpus, gate) + (
        f", t AS (SELECT *, {entropy('secret')} AS entropy, strpos(line, secret) AS pos FROM tok) SELECT {columns} FROM t "
        "WHERE entropy >= 4.5 AND NOT (pos > 1 AND line[pos - 1] IN ('/', ':', '@')) AND length(secret) - length(replace(secret, '/', '')) < 2"
    )


def auth_headers(corpus: str) -> str:
    parts = [
        f"SELECT path, line_no, {quoted(n)} AS rule, {s} AS severity, regexp_extract(line, {quoted(p)}, 1) AS secret FROM lines WHERE regexp_matches(line, {quoted(p)})"
        for n, s, p in AUTH_HEADERS
    ]
    return f"WITH {lines(corpus)} " + " UNION ALL ".join(parts)


def url_secrets(corpus: str) -> str:
    return f"WITH {lines(corpus)} SELECT path, line_no, unnest(regexp_extract_all(line, {quoted(URL_SECRET)}, 1)) AS secret FROM lines"


def line_context(corpus: str) -> str:
    return (
        f"WITH {lines(corpus)} SELECT path, line_no, line, left({trimmed('coalesce(lag(line) OVER w, $e$$e$)')}, 500) AS line_before, "
        f"left({trimmed('coalesce(lead(line) OVER w, $e$$e$)')}, 500) AS line_after FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)"
    )


def words_entropy() -> str:
    return f"SELECT word, count(*) AS n, {entropy('word')} AS entropy FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word"


def multiline(corpus: str, window: int = 100) -> str:
    parts = []
    for r in RULES:
        if r.multi_line:
            parts.append(
                f"SELECT path, start, {quoted(r.name + '_multiline')} AS rule, {severity_of(r.severity)} AS severity, unnest(regexp_extract_all(body, {quoted(r.pattern)}, 0)) AS secret FROM windows"
            )
    return (
        f"WITH {lines(corpus)}, windows AS (SELECT * FROM (SELECT path, line_no, greatest(1, line_no - {window - 1}) AS start, "
        f"string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS {window - 1} PRECEDING) AS body FROM lines) WHERE line_no >= 2), m AS ("
        + " UNION ALL ".join(parts) + ") SELECT path, rule, severity, secret, min(start) AS line_no FROM m GROUP BY ALL"
    )


def endpoints(corpus: str) -> str:
    parts = [
        f"SELECT path, line_no, line, {i} AS ord, unnest(regexp_extract_all(line, {quoted(p)}, 1)) AS v FROM lines WHERE regexp_matches(line, {quoted(p)})"
        for i, p in enumerate(surface.ENDPOINTS)
    ]
    drop = " AND ".join(f"NOT ends_with(lower(endpoint), {quoted(x)})" for x in surface.ASSETS)
    return (
        f"WITH {lines(corpus)}, raw AS (" + " UNION ALL ".join(parts) + f"), e AS (SELECT path, line_no, {trimmed('v')} AS endpoint FROM raw), "
        f"ends AS (SELECT path, endpoint, min(line_no) AS line_no FROM e WHERE strlen(endpoint) >= 5 AND {drop} GROUP BY ALL)"
    )


def risk(c: str) -> str:
    groups = []
    for g in dict.fromkeys(r[3] for r in surface.RISKS):
        own = [
            f"CASE WHEN regexp_matches({c}, {quoted(p)})" + (f" AND regexp_matches({c}, {quoted(surface.API_PATH)})" if need else "") + f" THEN {w} ELSE 0 END"
            for p, w, need, name in surface.RISKS if name == g
        ]
        groups.append(f"greatest({', '.join(own)}, 0)")
    return f"least({' + '.join(groups)}, 10)"


def rule_hits(text: str, source: str, keep: str, prefix: str, rules=RULES, floor: float = 2.0) -> str:
    """keep, rule (with the prefix, an expression), severity, secret of rules over a text column, without context gates,
    from the entropy floor on."""
    parts = [
        f"SELECT {keep}, {prefix} || {quoted(r.name)} AS rule, {severity_of(r.severity)} AS severity, unnest(regexp_extract_all({text}, {quoted(r.pattern)}, 0)) AS secret "
        f"FROM {source} WHERE regexp_matches({text}, {quoted(r.pattern)})"
        for r in rules
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {entropy('secret')} >= {floor}"


def decoded_pieces(corpus: str) -> str:
    """CTEs pieces (path, line_no, tag, text): printable texts of base64 and hexadecimal runs."""
    return (
        f"{lines(corpus)}, b AS (SELECT path, line_no, 'base64' AS tag, unnest(regexp_extract_all(line, '\\b[A-Za-z0-9+/]{{32,}}\\b', 0)) AS m FROM lines), "
        "h AS (SELECT path, line_no, 'hex' AS tag, unnest(regexp_extract_all(line, '\\b(?:[0-9a-fA-F]{2}){10,}\\b', 0)) AS m FROM lines), "
        "raw AS (SELECT path, line_no, tag, TRY(from_base64(m || repeat('=', (-length(m)) % 4 + CASE WHEN length(m) % 4 = 0 THEN 0 ELSE 4 END))) AS data FROM b WHERE length(m) % 4 <> 1 "
        "UNION ALL SELECT path, line_no, tag, TRY(unhex(m)) FROM h WHERE m = lower(m) OR m = upper(m)), "
        "pieces AS (SELECT path, line_no, tag, decode(data) AS text FROM raw WHERE data IS NOT NULL AND regexp_full_match(hex(data), '(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)+'))"
    )


def scan_decoded(corpus: str, context: bool = False) -> str:
    keep = "path, line_no" + (", tag || ' decoded: ' || left(text, 500) AS context" if context else "")
    return f"WITH {decoded_pieces(corpus)} " + rule_hits("text", "pieces", keep, "tag || '_'")


# ---- script text ---------------------------------------------------------------------------------------

LITERAL = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
DECLARED = r"\b(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=\s*"


def literals(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {quoted(LITERAL)}, 0), lambda x: x[2:-2])"


def expressions(pattern: str) -> str:
    return f"SELECT path, line_no, unnest(regexp_extract_all(line, {quoted(pattern)}, 0)) AS expr FROM lines"


def rebuilt(corpus: str) -> str:
    """CTEs up to rebuilt (path, line_no, kind, text)."""
    joined = rf"\[\s*(?:{LITERAL}\s*,\s*)+{LITERAL}\s*,?\s*\]\s*\.\s*join\s*\(\s*{LITERAL}\s*\)"
    names = r"\b[A-Za-z_$][\w$]*(?:\s*\+\s*[A-Za-z_$][\w$]*)+"
    one, many = quoted(DECLARED + "(" + LITERAL + r")\s*(?:;|,|\n|\z)"), quoted(DECLARED + r"\[([^\]]+)\]")
    chain, choice, at = expressions(LITERAL + rf"(?:\s*\+\s*{LITERAL})+"), expressions(rf"\?\s*{LITERAL}\s*:\s*{LITERAL}"), expressions(r"\b[A-Za-z_$][\w$]*\[\d{1,9}\]")

    def declared(pattern: str) -> str:
        return (
            "SELECT path, generate_subscripts(n, 1) AS i, unnest(n) AS name, unnest(v) AS value FROM "
            f"(SELECT path, regexp_extract_all(content, {pattern}, 1) AS n, regexp_extract_all(content, {pattern}, 2) AS v FROM corpus)"
        )

    return f"""{lines(corpus)},
 decl AS ({declared(one)}), consts AS (SELECT path, name, arg_max(value, i)[2:-2] AS value FROM decl GROUP BY ALL),
 adecl AS ({declared(many)}), arrs AS (SELECT path, name, arg_max(e, i) AS elements FROM (SELECT path, name, i, {literals("value")} AS e FROM adecl) WHERE len(e) > 0 GROUP BY ALL),
 concats AS (SELECT path, line_no, array_to_string({literals("expr")}, '') AS text FROM ({chain})),
 joins AS (SELECT path, line_no, list_reduce(t[1:-2], lambda a, b: a || t[-1] || b) AS text FROM (SELECT path, line_no, {literals("expr")} AS t FROM ({expressions(joined)}))),
 sums AS (SELECT row_number() OVER () AS n, * FROM ({expressions(names)})),
 parts AS (SELECT n, path, line_no, generate_subscripts(p, 1) AS i, unnest(p) AS name FROM (SELECT *, regexp_split_to_array(expr, '\\s*\\+\\s*') AS p FROM sums)),
 vars AS (SELECT path, line_no, array_to_string(list(value ORDER BY i), '') AS text FROM parts LEFT JOIN consts USING (path, name) GROUP BY n, path, line_no HAVING count(*) = count(value)),
 choices AS (SELECT path, line_no, unnest({literals("expr")}) AS text FROM ({choice})),
 refs AS (SELECT path, line_no, regexp_extract(expr, '^([^\\[]*)', 1) AS name, regexp_extract(expr, '\\[(\\d+)\\]', 1)::INT AS idx FROM ({at})),
 gets AS (SELECT path, line_no, elements[idx + 1] AS text FROM refs JOIN arrs USING (path, name)),
 ticks AS (SELECT path, line_no, unnest(regexp_extract_all(line, '`([^`$]*)`', 1)) AS text FROM lines),
 rebuilt AS (SELECT * FROM (SELECT path, line_no, 'concat' AS kind, text FROM concats WHERE NOT regexp_matches(text, '[{{}}\\[\\]:,]') UNION ALL SELECT path, line_no, 'join', text FROM joins
  UNION ALL SELECT path, line_no, 'var', text FROM vars UNION ALL SELECT path, line_no, 'ternary', text FROM choices UNION ALL SELECT path, line_no, 'array', text FROM gets WHERE text IS NOT NULL
  UNION ALL SELECT path, line_no, 'template', text FROM ticks) WHERE strlen(text) >= 20)"""


def scan_rebuilt(corpus: str, longest: int | None = 200) -> str:
    """Hits of the rules in the first part of rebuilt texts; in whole texts if longest is None."""
    keep = "path, line_no", "'reconstructed_' || kind || '_'"
    if longest is None:
        return f"WITH {rebuilt(corpus)} " + rule_hits("text", "rebuilt", *keep)
    return f"WITH {rebuilt(corpus)}, short AS (SELECT path, line_no, kind, left(text, {longest}) AS text FROM rebuilt) " + rule_hits("text", "short", *keep)


def occurrences(corpus: str) -> str:
    """CTEs up to f (path, line_no, line, kind, value): facts where they stand; kinds as they are found."""
    keep = {
        "module": "(contains(v, '/') OR starts_with(v, '.'))", "todo": "(contains(v, 'key') OR contains(v, 'token') OR contains(v, 'secret') OR contains(v, 'password'))",
        "config_secret": "(strlen(v) > 5 AND v NOT IN ('xxx', 'your_key_here', 'CHANGE_ME'))", "route": "(starts_with(v, '/') AND NOT starts_with(v, '//'))",
        "chunk": "(" + " OR ".join(f"regexp_matches(line, {quoted(p)})" for p in scripts.BUNDLERS) + ")",
        "base64": "coalesce(regexp_matches(TRY(decode(from_base64(v || CASE WHEN contains(v, '=') THEN '' ELSE repeat('=', (4 - length(v) % 4) % 4) END))), 'http|key|token|secret'), false)",
    }
    parts = [
        f"SELECT path, line_no, line, {quoted(k)} AS kind, v AS value FROM (SELECT path, line_no, line, {trimmed('m')} AS v FROM "
        f"(SELECT path, line_no, line, unnest(regexp_extract_all(line, {quoted(p)}, 1)) AS m FROM lines)) WHERE v <> '' AND {keep.get(k, 'true')}"
        for k, p in scripts.FACTS
    ]
    return f"{lines(corpus)}, f AS (" + " UNION ALL ".join(parts) + ")"


def facts(corpus: str) -> str:
    kind = "CASE kind WHEN 'env_meta' THEN 'env' WHEN 'module' THEN 'endpoint' WHEN 'route' THEN 'endpoint' WHEN 'todo' THEN 'comment_leak' ELSE kind END"
    value = "CASE WHEN kind = 'env_meta' THEN 'IMPORT_META_' || value ELSE value END"
    return f"WITH {occurrences(corpus)} SELECT path, {kind} AS kind, {value} AS value, min(line_no) AS line_no FROM f GROUP BY ALL"


def script_findings(corpus: str) -> str:
    ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN (" + ", ".join(map(quoted, scripts.EXTENSIONS)) + ")"
    return f"""WITH {occurrences(corpus)}, own AS (SELECT * FROM f WHERE {ext})
SELECT path, line_no, 'js_secret_' || CASE kind WHEN 'todo' THEN 'comment_leak' ELSE kind END AS rule, CASE kind WHEN 'todo' THEN 2 ELSE 3 END AS severity, value AS secret FROM own WHERE kind IN ('todo', 'base64', 'config_secret')
UNION ALL SELECT DISTINCT path, 1, CASE kind WHEN 'debug' THEN 'debug_artifact' WHEN 'sensitive_file' THEN 'sensitive_file_ref' WHEN 'leaked_comment' THEN 'comment_leak' ELSE kind END, CASE kind WHEN 'debug' THEN 1 ELSE 2 END, value
 FROM own WHERE kind IN ('internal_url', 'debug', 'sensitive_file') OR kind = 'leaked_comment' AND regexp_matches(value, 'api|key|token|secret|internal')"""


def json_findings(corpus: str) -> str:
    key = "CASE WHEN contains(key_path, '.') THEN regexp_extract(key_path, '\\.([^.]*)$', 1) WHEN contains(key_path, '[') THEN regexp_extract(key_path, '(\\[[^\\[]*)$', 1) ELSE key_path END"
    return f"""WITH docs AS (SELECT * FROM ({CORPORA[corpus]}) WHERE path LIKE '%.json'),
 leaves AS (SELECT docs.path AS path, substr(t.fullkey, 3) AS key_path, t.atom ->> '$' AS value FROM docs, json_tree(content::JSON) AS t WHERE t.type = 'VARCHAR'), k AS (SELECT *, {key} AS key FROM leaves WHERE value <> '')
SELECT path, 0 AS line_no, 'json_' || key AS rule, 2 AS severity, value AS secret FROM k WHERE regexp_matches(key, {quoted(trees.SECRET_KEY)}) AND length(value) >= 8 AND NOT regexp_full_match(value, '[0-9]+') AND {entropy('value')} >= 3.0
UNION ALL """ + rule_hits("value", "k", "path, 0 AS line_no", "'json_'")


def endpoint_findings(corpus: str) -> str:
    return endpoints(corpus) + f" SELECT path, line_no, 'endpoint' AS rule, 0 AS severity, endpoint AS secret, {risk('endpoint')} AS risk FROM ends"


def signals(responses: str) -> str:
    """url, ord, technology, category, confidence, severity, version of responses (url, place, name, value)."""
    parts = []
    for n, (group, where, kind, needle, tech, cat, conf, sev, version) in enumerate(technology.SIGNALS):
        text = "value"
        if where == "cookie":
            test = "place = 'cookie' AND " + (f"starts_with(lower(name), {quoted(needle)})" if kind == "starts" else f"lower(name) = {quoted(needle)}")
            text = "''"
        else:
            place = "place = 'body'" if where in ("body", "generator") else f"place = 'header' AND name = {quoted(where)}"
            if where == "generator":
                text = f"regexp_extract(value, {quoted(technology.GENERATOR)}, 1)"
            test = place + " AND " + {
                "has": f"contains(lower({text}), {quoted(needle)})", "is": f"lower({text}) = {quoted(needle)}", "set": f"{text} <> ''", "like": f"regexp_matches({text}, {quoted(needle)})",
            }[kind]
        found = f"regexp_extract({text}, {quoted(version)}, 1)" if version else "''"
        parts.append(
            f"SELECT url, {n} AS ord, {quoted(group or str(n))} AS grp, {quoted(tech)} AS technology, {quoted(cat)} AS category, {conf} AS confidence, {sev} AS severity, {found} AS version FROM r WHERE {test}"
        )
    return (
        f"WITH r AS ({responses}) SELECT url, ord, technology, category, confidence, severity, version FROM ({' UNION ALL '.join(parts)}) "
        "QUALIFY row_number() OVER (PARTITION BY url, grp ORDER BY ord) = 1"
    )


def fronts(responses: str) -> str:
    parts = [
        f"SELECT url, {quoted(vendor)} AS vendor FROM r WHERE name = {quoted(name)} AND (" + (" OR ".join(f"contains(lower(value), {quoted(p)})" for p in need) or "value <> ''") + ")"
        for vendor, name, need in surface.FRONTS
    ]
    return f"WITH r AS ({responses}) " + " UNION ".join(parts)


def storage(corpus: str) -> str:
    parts = [
        f"SELECT path, {i} AS ord, {quoted(n)} AS provider, unnest(regexp_extract_all(content, {quoted(p)}, 0)) AS url FROM corpus" for i, (n, p) in enumerate(surface.STORAGE)
    ]
    return f"WITH corpus AS ({CORPORA[corpus]}), r AS (" + " UNION ALL ".join(parts) + ") SELECT path, url, arg_min(provider, ord) AS provider FROM r GROUP BY ALL"


def classes(urls: str) -> str:
    parts = [f"SELECT url, {quoted(n)} AS category, {s} AS severity FROM urls WHERE {_any('url', ps)}" for n, s, ps in surface.SURFACES]
    when = " ".join(f"WHEN {_any('url', ps)} THEN {quoted(n)}" for n, _, ps in surface.INTERNAL)
    sev = " ".join(f"WHEN {quoted(n)} THEN {s}" for n, s, _ in surface.INTERNAL)
    parts.append(f"SELECT url, c AS category, CASE c {sev} END AS severity FROM (SELECT url, CASE {when} END AS c FROM urls) WHERE c IS NOT NULL")
    return f"WITH urls AS ({urls}) " + " UNION ALL ".join(parts)


def category(c: str) -> str:
    when = " ".join("WHEN " + " OR ".join(f"contains({c}, {quoted(p)})" for p in parts) + f" THEN {quoted(n)}" for n, parts in post.CATEGORIES)
    return f"CASE {when} ELSE 'other' END"


def downgraded(corpus: str) -> str:
    names = ", ".join(map(quoted, post.NON_PRODUCTION))
    folder = f"list_has_any(string_split(path, '/')[1:-2], [{names}])"
    return deduplicated(corpus) + (
        f", lower_findings AS (SELECT * REPLACE (CASE WHEN regexp_matches(context, {quoted(post.PLACEHOLDER)}) THEN 0 "
        f"WHEN {folder} AND severity > 0 THEN severity - 1 ELSE severity END AS severity) FROM unique_findings)"
    )


FINGERPRINT = "left(sha256(rule || '|' || secret || '|' || path), 32)"
IGNORE_ID = "sha256(rule || ':' || secret || ':' || path)"


def pairs() -> str:
    specs = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(n)}, {s})" for a, b, n, s in post.PAIRS)
    return (
        findings("derived_files") + f", specs(rule_a, rule_b, pair, span) AS (VALUES {specs}) "
        "SELECT a.path, pair, a.line_no AS line_a, b.line_no AS line_b, rule_a, rule_b, a.secret AS secret_a, b.secret AS secret_b FROM specs "
        "JOIN findings a ON a.rule = rule_a JOIN findings b ON b.rule = rule_b AND a.path = b.path AND abs(a.line_no - b.line_no) <= span"
    )


def file_pattern(c: str) -> str:
    dirs = f"list_filter(string_split(lower({c}), '/')[1:-2], lambda d: d IN ('test','tests','__tests__','mock','mocks','__mocks__','vendor','node_modules','example','examples','fixtures'))[1]"
    return (
        f"CASE WHEN {dirs} IN ('test','tests','__tests__') THEN '*/test/*' WHEN {dirs} IN ('mock','mocks','__mocks__') THEN '*/mock/*' WHEN {dirs} = 'vendor' THEN '*/vendor/*' "
        f"WHEN {dirs} = 'node_modules' THEN '*/node_modules/*' WHEN {dirs} IN ('example','examples','fixtures') THEN '*/example/*' "
        f"WHEN regexp_extract({c}, '(\\.[^./]*)$', 1) <> '' THEN '*' || regexp_extract({c}, '(\\.[^./]*)$', 1) ELSE '*' END"
    )


def modifier(fp: str, tp: str, n: str, rule: str) -> str:
    m = f"((1 - 2 * ({fp} + 5.0) / ({fp} + {tp} + 10.0)) * 40 * CASE WHEN {n} < 20 THEN {n} / 20.0 ELSE 1 END)"
    names = ", ".join(map(quoted, post.HIGH_CERTAINTY))
    return f"least(greatest(CASE WHEN {rule} IN ({names}) AND {m} < -10 THEN -10.0 ELSE {m} END, -40.0), 40.0)"
