"""Queries of sources and captured feeds: files as bytes, encodings, host names, archives of addresses, schemas, probes,
and of expressions over texts."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions import text as T
from ..operators import decode, detect, feeds, maps, post
from ..sources import corpora, files, reports
from . import sql
from .fixtures import planted, unique_findings
from .registry import register

_TEXT = "a text of more than sixty-four bytes, so that it is worth the trouble to pack it at all\n"


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("in/a.txt", "first"), ("../out.txt", "outside"), ("/abs.txt", "absolute"), ("b.bin", "\0" * 20)):
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("x/c.txt")
        info.size = 6
        t.addfile(info, io.BytesIO(b"second"))
    return out.getvalue()


def _bytes(spark, d, **named: bytes):
    """(path, content): the bytes under each name, for each nation."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(b).alias("b")) for n, b in named.items())))
    return corpora.read(spark, d, "nation").select(F.col("n_name").alias("nation"), rows.alias("r")).select(F.concat("nation", F.lit("."), "r.n").alias("path"), F.col("r.b").alias("content"))


@register("archive_members", "SELECT n_name || p AS path, c AS content FROM nation, (VALUES ('.zip!in/a.txt', 'first'), ('.tgz!x/c.txt', 'second')) AS v(p, c)")
def _archives(spark, d):
    return files.archive_members(_bytes(spark, d, zip=_zip(), tgz=_tar(), txt=b"no archive"))


@register("unread_members", "SELECT n_name || p AS path, 'path' AS reason FROM nation, (VALUES ('.zip!../out.txt'), ('.zip!/abs.txt')) AS v(p)")
def _unread(spark, d):
    return files.unread_members(_bytes(spark, d, zip=_zip(), tgz=_tar()))


@register("inflated_files", f"SELECT n_name || p AS path, '{_TEXT.strip()}' || chr(10) AS content FROM nation, (VALUES ('.gz'), ('.zz')) AS v(p)")
def _inflated(spark, d):
    noise = bytes((i * 7919) % 251 for i in range(400))
    packed = {"gz": gzip.compress(_TEXT.encode(), 0, mtime=0), "zz": zlib.compress(_TEXT.encode(), 0), "no": noise, "short": gzip.compress(b"x", mtime=0)}
    return files.inflated_files(_bytes(spark, d, **packed))


@register("binary_strings", "SELECT n_name || '.exe (binary)' AS path, c AS content FROM nation, (VALUES ('readable run'), ('größer als acht')) AS v(c)")
def _strings(spark, d):
    return files.binary_strings(_bytes(spark, d, exe=b"\x00\x01readable run\xff\xfeshort\x00" + "größer als acht".encode() + b"\x80"))


@register("inflated_inline", "SELECT n_name AS path, 'gzip' AS tag, 'packed text of some length, packed text of some length' AS text FROM nation")
def _inline(spark, d):
    import base64

    packed = base64.b64encode(gzip.compress(b"packed text of some length, packed text of some length", mtime=0)).decode()
    rows = corpora.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit(f'x = "{packed}"').alias("content"))
    return decode.decoded(rows, ("gzip",), depth=1).select("path", "tag", "text")


@register(
    "captured_text",
    "SELECT n_name AS path, CASE n_nationkey % 3 WHEN 0 THEN 'café' WHEN 1 THEN '<meta charset=\"windows-1252\">€5' ELSE 'naïve' END AS content FROM nation",
)
def _captured(spark, d):
    k = F.col("n_nationkey") % 3
    body = F.when(k == 0, F.lit("café".encode("latin-1"))).when(k == 1, F.lit(b'<meta charset="windows-1252">\x805')).otherwise(F.lit("naïve".encode()))
    rows = corpora.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.when(k == 0, "text/html; charset=ISO-8859-1").alias("content_type"), body.alias("content"))
    return feeds.as_text(rows)


@register("host_names", "SELECT 'n' || n_nationkey || '.example.com' AS name FROM nation UNION SELECT 'www.example.com'")
def _hosts(spark, d):
    k = F.col("n_nationkey").cast("string")
    return feeds.host_names(corpora.read(spark, d, "nation").select(F.concat(F.lit("*.N"), k, F.lit(".Example.com\n www.example.com \nbadexample.com\nx.example.org")).alias("value")), "example.com")


@register("archived_urls", "SELECT 'https://x.example.com/' || n_nationkey AS url, '1' AS timestamp, '200' AS status, 'text/html' AS mime FROM nation")
def _archived(spark, d):
    k = F.col("n_nationkey").cast("string")
    kinds = (("http://web.archive.org/web/2024/https://x.example.com/", "2", "200", "text/html"), ("https://x.example.com/", "1", "200", "text/html"), ("https://x.example.com/gone", "1", "404", "text/html"),
             ("https://x.example.com/img", "1", "200", "image/png"), ("https://other.org/", "1", "200", "text/html"))
    rows = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("o", "timestamp", "status", "mime"), x, strict=True))) for x in kinds)))
    each = corpora.read(spark, d, "nation").select(k.alias("k"), rows.alias("r")).select(F.concat("r.o", "k").alias("original"), "r.timestamp", "r.status", "r.mime")
    return feeds.archived_urls(each, "example.com")


@register(
    "graphql_types",
    "SELECT n_name AS path, c AS category, s AS source FROM nation, (VALUES ('graphql_sensitive_query', 'graphql_query_allUsers'), ('graphql_mutation_input', 'graphql_input_Login'), ('graphql_sensitive_mutation', 'graphql_mutation_setEmail')) AS v(c, s)",
)
def _graphql(spark, d):
    schema = (
        '{"data": {"__schema": {"queryType": {"name": "Q"}, "mutationType": {"name": "M"}, "types": [{"name": "Q", "kind": "OBJECT", "fields": [{"name": "allUsers"}, {"name": "ping"}]},'
        ' {"name": "M", "kind": "OBJECT", "fields": [{"name": "setEmail"}]}, {"name": "Login", "kind": "INPUT_OBJECT", "inputFields": [{"name": "newPassword"}]}, {"name": "Other", "kind": "OBJECT", "fields": [{"name": "token"}]}]}}}'
    )
    return feeds.graphql_types(corpora.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit(schema).alias("content")))


@register(
    "interesting_probes",
    "SELECT o_orderkey, (200 + o_orderkey % 3 * 100 <> 200) OR abs(900 + o_orderkey % 400 - 1000) > 100 OR o_orderkey % 7 = 0 AS found FROM orders",
)
def _probes(spark, d):
    k = F.col("o_orderkey")
    hit = feeds.interesting((200 + k % 3 * 100).cast("int"), (900 + k % 400).cast("int"), F.lit(200), F.lit(1000), k % 7 == 0)
    return corpora.read(spark, d, "orders").select("o_orderkey", hit.alias("found"))


@register("mixed_input_urls", "SELECT 'url' AS kind, url AS value FROM pages")
def _mixed(spark, d):
    rows = corpora.read(spark, d, "pages").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("value"))
    return feeds.mixed_input(rows.unionByName(corpora.read(spark, d, "nation").select(F.col("n_name").alias("value"))))


@register("mixed_input_text", "SELECT 'text' AS kind, n_name AS value FROM nation")
def _mixed_text(spark, d):
    names = corpora.read(spark, d, "nation").select(F.col("n_name").alias("value"))
    return feeds.mixed_input(names.unionByName(spark.range(2).select(F.lit("  ").alias("value"))))


@register("lines_without_comments", f"WITH {sql.lines('planted')} SELECT path, line_no, CASE WHEN regexp_matches({sql.trimmed('line')}, '^(?://|#|;|--)') THEN '' ELSE line END AS line FROM lines")
def _comments(spark, d):
    rows = planted(spark, d).withColumn("content", T.without_comments(F.col("content")))
    return T.lines(rows).select("path", "line_no", "line")


@register("rules_in_short_lines", sql.findings("planted") + " SELECT path, line_no, rule, severity, secret FROM findings WHERE strlen(line) <= 40")
def _short(spark, d):
    return detect.scan(planted(spark, d), max_line=40).where("method = 'regex'").select("path", "line_no", "rule", "severity", "secret")


@register("media_tokens", "SELECT o_orderkey, o_orderkey % 5 < 4 AS media FROM orders")
def _media(spark, d):
    k = F.col("o_orderkey")
    heads = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF\x00\x00\x00\x00WEBP", b"RIFF\x00\x00\x00\x00WAVE")
    body = F.concat(F.get(F.array(*map(F.lit, heads)), (k % 5).cast("int")), F.unhex(F.substring(F.sha2(k.cast("string"), 256), 1, 40)))
    return corpora.read(spark, d, "orders").select("o_orderkey", E.media(F.base64(body)).alias("media"))


_CELL = "'k' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN ',x' WHEN 1 THEN '\"q\"' WHEN 2 THEN '<b>&' ELSE chr(10) || 'z' END"


@register(
    "escaped_cells",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(c, '[,"\\n\\r]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS csv, replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html
 FROM (SELECT o_orderkey, {_CELL} AS c FROM orders)""",
)
def _cells(spark, d):
    k = F.col("o_orderkey")
    c = F.concat(F.lit("k"), k.cast("string"), F.get(F.array(*map(F.lit, (",x", '"q"', "<b>&", "\nz"))), (k % 4).cast("int")))
    return corpora.read(spark, d, "orders").select("o_orderkey", T.csv_escaped(c).alias("csv"), T.html_escaped(c).alias("html"))


@register("script_map_urls", "SELECT n_name AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'app.' || n_nationkey || '.js.map' ELSE '' END AS url FROM nation")
def _map_urls(spark, d):
    k = F.col("n_nationkey")
    near = F.concat(F.lit("run();\n//# sourceMappingURL=old.map\n//# sourceMappingURL=app."), k.cast("string"), F.lit(".js.map\n"))
    far = F.concat(F.lit("//# sourceMappingURL=far.map"), F.lit("\nx" * 9))
    rows = corpora.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.when(k % 2 == 0, near).otherwise(far).alias("content"))
    return rows.select("path", feeds.source_map_url(F.col("content")).alias("url"))


@register("inline_source_maps", "SELECT n_name AS path, 's' || n_nationkey || '.js' AS source FROM nation")
def _inline_maps(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.lit('{"sources":["s'), k.cast("string"), F.lit('.js"]}'))
    url = F.when(k % 2 == 0, F.concat(F.lit("data:application/json;base64,"), F.base64(text.cast("binary")))).otherwise(F.concat(F.lit("data:application/json,"), F.url_encode(text)))
    rows = corpora.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.concat(F.lit("x\n//# sourceMappingURL="), url).alias("content"))
    return maps.source_map_files(maps.inline_maps(rows)).select("path", "source")


@register("confidence_with_modifier", "SELECT o_orderkey, least(greatest(40 + 20 * (o_orderkey % 2) + (o_orderkey % 401 - 200), 0), 120)::INT AS score FROM orders")
def _modified(spark, d):
    k = F.col("o_orderkey")
    score = post.confidence_score(F.lit(True), F.when(k % 2 == 1, 5.0).otherwise(1.0), F.lit(False), F.lit(False), F.lit(False), (k % 401 - 200).cast("int"))
    return corpora.read(spark, d, "orders").select("o_orderkey", score.alias("score"))


@register("technology_bands", "SELECT o_orderkey, CASE WHEN o_orderkey % 101 >= 95 THEN 'CRITICAL' WHEN o_orderkey % 101 >= 80 THEN 'HIGH' WHEN o_orderkey % 101 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM orders")
def _bands(spark, d):
    return corpora.read(spark, d, "orders").select("o_orderkey", post.tech_band(F.col("o_orderkey") % 101).alias("band"))


@register(
    "ignore_file_filter",
    sql.deduplicated("derived_files") + " SELECT path, line_no, rule, secret FROM unique_findings WHERE NOT regexp_matches(secret, '^sk_live_[0-7]') AND NOT regexp_matches(path, '^sk_live_[0-7]') AND NOT regexp_matches(secret, '/6/') AND NOT regexp_matches(path, '/6/')",
)
def _ignored(spark, d):
    marks, patterns = post.ignore_rules("# known examples\nre:^sk_live_[0-7]  # test keys\n\nre:/6/\n0123456789abcdef\n")
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, marks))).alias("ignore_id"))
    return post.not_ignored(unique_findings(spark, d), listed, [p.strip() for p in patterns]).select("path", "line_no", "rule", "secret")


@register(
    "top_findings",
    sql.deduplicated("derived_files") + " SELECT path, line_no, rule, severity FROM unique_findings ORDER BY severity DESC, path, line_no, octet_length(encode(split_part(line, secret, 1))), rule, secret LIMIT 10",
)
def _top(spark, d):
    return reports._in_order(unique_findings(spark, d), 10).select("path", "line_no", "rule", "severity")


@register("log_levels", sql.deduplicated("derived_files") + " SELECT path, line_no, rule, CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END AS level FROM unique_findings")
def _levels(spark, d):
    levels = F.create_map(*(F.lit(x) for pair in reports.SARIF_LEVELS.items() for x in pair))
    return unique_findings(spark, d).select("path", "line_no", "rule", levels[F.col("severity")].alias("level"))
