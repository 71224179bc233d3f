"""Links of captured pages and scripts, resolved against their address."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import compiled
from .surface import endpoints

# Elements (* is any) and their attributes that hold a link.
LINK_ATTRIBUTES = (
    ("a", ("href", "ping")), ("link", ("href",)), ("script", ("src",)), ("img", ("src", "dynsrc", "lowsrc", "longdesc")), ("iframe", ("src",)), ("frame", ("src",)),
    ("embed", ("src",)), ("object", ("data", "codebase")), ("video", ("src", "poster")), ("audio", ("src",)), ("source", ("src",)), ("table", ("background",)),
    ("td", ("background",)), ("body", ("background",)), ("button", ("formaction",)), ("blockquote", ("cite",)), ("area", ("ping",)), ("base", ("href",)),
    ("html", ("manifest",)), ("*", ("hx-get", "hx-post", "hx-put", "hx-patch")),
)
# Elements with a list of image candidates; elements of an svg with a link.
CANDIDATES = ("img", "source")
DRAWN = ("image", "script")
# Fixed value: strings in scripts that look like an address; group 1.
SCRIPT_LINK = r"""(?:"|')((?:https?://[^\s"']+|[./][^\s"']+))(?:["' ])"""
_OTHER = ("mailto:", "javascript:", "vbscript:")
#: Signs that stay as they are in the path and in the query of an address.
_PATH, _QUERY = "$&+,/:;=@~%!*'()", "$&+,/:;=@~%!*'()?[]"
_SCRIPT_END = re.compile(r"</script", re.I)


def resolved(raw: str, base: str) -> str:
    """The absolute http address of a link; empty for others."""
    raw = raw.strip()
    if not raw or raw.startswith(("#", "data:")) or raw.lower().startswith(_OTHER):
        return ""
    try:
        u = urlsplit(urljoin(base, raw))
    except ValueError:
        return ""
    if u.scheme not in ("http", "https"):
        return ""
    return urlunsplit((u.scheme, u.netloc, quote(u.path, _PATH), quote(u.query, _QUERY), quote(u.fragment, _QUERY)))


class _Page(HTMLParser):
    """Raw links in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.by_tag = dict(LINK_ATTRIBUTES)
        self.drawing = 0
        self.script: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = {k: v for k, v in reversed(attrs) if v is not None}
        for name in (*self.by_tag.get(tag, ()), *self.by_tag["*"]):
            if name in have:
                self.found.append(have[name])
        if tag in CANDIDATES and "srcset" in have:
            self.found += [part.split()[0] for part in have["srcset"].split(",") if part.split()]
        if tag == "input" and have.get("type", "").lower() == "image" and "src" in have:
            self.found.append(have["src"])
        if tag == "meta" and "url=" in have.get("content", "").lower():
            self.found.append(have["content"][have["content"].lower().index("url=") + 4 :])
        if tag == "svg":
            self.drawing += 1
        elif tag in DRAWN and self.drawing:
            self.found += [have[k] for k in ("href", "xlink:href") if k in have][:1]
        if tag == "script":
            self.script = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "svg":
            self.drawing = max(0, self.drawing - 1)
        elif tag == "script" and self.script is not None:
            self.found += [m.group(1) for m in compiled(SCRIPT_LINK).finditer("".join(self.script))]
            self.script = None

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)


def page_links(html: str, url: str) -> list[str]:
    """Absolute links of a page, each once, in order."""
    page = _Page()
    page.feed(html)
    page.close()
    return list(dict.fromkeys(x for x in (resolved(r, url) for r in page.found) if x))


def _mapped(rows: DataFrame, find) -> DataFrame:
    """(url, link) of rows (url, text)."""

    def run(batches):
        for b in batches:
            pairs = [(u, x) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if u is not None and t for x in find(t, u)]
            cols = list(zip(*pairs, strict=True)) if pairs else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["url", "link"])

    return rows.mapInArrow(run, "url string, link string")


def html_links(pages: DataFrame) -> DataFrame:
    """(url, link) of (url, html)."""
    return _mapped(pages.select("url", "html"), page_links)


def script_links(scripts: DataFrame) -> DataFrame:
    """(url, link) of scripts (url, content): strings that look like an address, and endpoints, each once."""

    def strings(text: str, url: str) -> list[str]:
        return list(dict.fromkeys(x for x in (resolved(m.group(1), url) for m in compiled(SCRIPT_LINK).finditer(text)) if x))

    def whole(text: str, url: str) -> list[str]:
        x = text if text.startswith(("http://", "https://")) else resolved(text, url)
        return [x] if x else []

    found = endpoints(scripts.select(F.col("url").alias("path"), "content")).select(F.col("path").alias("url"), "endpoint")
    return _mapped(scripts.select("url", "content"), strings).unionByName(_mapped(found, whole)).distinct()


def links_of(captured: DataFrame) -> DataFrame:
    """(url, link) of captured (url, content_type, content): pages and scripts each in their way."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    pages = captured.where(kind.contains("html")).select("url", F.col("content").alias("html"))
    scripts = captured.where(~kind.contains("html") & (kind.contains("javascript") | path.endswith(".js"))).select("url", "content")
    return html_links(pages).unionByName(script_links(scripts))
