from sievelight.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">{menu}</a></li><li><a>two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy {menu}</div><aside>side</aside>
<article><h1>Title {n}</h1><p>First &amp; <b>bold   text<br>of {n}.<p>Second&nbsp;part <a href=x>link</a></p><div class="share">Share this</div>
<p>Subscribe to us now</p><form>mail <input></form></article><div id="comments"><p>reader says</p></div><footer>&copy; host</footer></body></html>"""
TEXT = "Title {n}\n\nFirst & bold text of {n}.\n\nSecond part link"


def page(n):
    return PAGE.format(n=n, menu=f"m{n}")


def test_template_and_slots():
    assert H.extract(page(7), None) == TEXT.format(n=7) + "\n\nSubscribe to us now"
    assert H.extract(page(7), H.induce([page(n) for n in range(5)])) == TEXT.format(n=7)
    plain = "<div class=x><div class=top>Constant line</div><div class=body><p>{a}</p><p>{b}</p></div><div class=low><a>x {n}</a></div></div>"
    pages = [plain.format(a=f"long text number {n} " * 5, b=f"more of {n} " * 5, n=n) for n in range(6)]
    got = H.extract(pages[3], H.induce(pages))
    assert got == f"{('long text number 3 ' * 5).strip()}\n\n{('more of 3 ' * 5).strip()}"


def test_wrapper_alone_finds_the_article():
    """No marks, no telling names: what is the same on the host's pages goes, with optional parts in between."""
    part = "<div><p>We write about {topic} since 1999.</p><p>All rights kept.</p></div>"
    html = "<body><div><p>The Daily Something</p><ul><li>News</li><li>Letters</li></ul></div>{extra}<div><h1>{title}</h1><p>{a}</p><p>{b}</p></div>" + part + "</body>"

    def one(n, extra):
        return html.format(title=f"Title {n}", a=f"first words of {n}", b=f"second words of {n}", topic="ships", extra=extra)

    notice = "<div><p>We are looking for editors.</p></div>"
    pages = [one(n, notice if n % 3 == 0 else "") for n in range(12)]
    wrapper = H.induce(pages)
    for n, p in enumerate(pages):
        assert H.extract(p, wrapper) == f"Title {n}\n\nfirst words of {n}\n\nsecond words of {n}"
        off = H.extract(p, None)
        assert off.startswith("The Daily Something") and off.endswith("All rights kept.")
    assert H.induce(pages[::-1]).fixed == wrapper.fixed and H.shape(H.induce(pages[::-1]).tree) == H.shape(wrapper.tree)


def test_all_pages_count():
    """Neither an early page without a notice nor the order of pages changes what is template."""
    html = "<body><article><p>text {n}</p></article>{x}<div><p>{n} more</p></div></body>"
    notice = "<section><p>Please read our terms</p></section>"
    plain = "<body><div><h2>head {n}</h2><p>text {n}</p></div>{x}</body>"
    pages = [plain.format(n=n, x="" if n < 9 else notice) for n in range(30)]
    wrapper = H.induce(pages)
    assert H.extract(pages[0], wrapper) == "head 0\n\ntext 0"
    assert H.extract(pages[20], wrapper) == "head 20\n\ntext 20"
    assert H.extract(html.format(n=1, x=notice), wrapper) == "text 1"


def test_menus_are_told_by_all_pages():
    """A list that consists of links on one page is no menu if it is none on the others."""
    html = "<body><div><h1>Title {n}</h1>words of page {n}</div><div><ol><li>{a}</li><li>{b}</li></ol></div></body>"
    pages = [html.format(n=n, a=f"a long plain reference number {n}", b=f"another plain reference {n}") for n in range(6)]
    pages.append(html.format(n=9, a="<a href=x>short</a>", b="<a href=y>links</a>"))
    assert H.extract(pages[-1], H.induce(pages)).endswith("short\n\nlinks")
    assert "short" not in H.extract(pages[-1], None)


def test_copies_of_a_page_keep_their_text():
    same = "<body><div><h1>Title</h1><p>the one text</p></div><div><p>menu {n}</p></div></body>"
    wrapper = H.induce([same.format(n=1)] * 9)
    assert H.extract(same.format(n=1), wrapper) == "Title\n\nthe one text\n\nmenu 1"
    marked = "<body><article><h1>Title</h1><p>the one text</p></article><div><p>menu {n}</p></div></body>"
    assert H.extract(marked.format(n=3), H.induce([marked.format(n=n) for n in range(9)])) == "Title\n\nthe one text"


def test_limits_are_parameters():
    pages = [f"<body><article><h2>Read this first</h2><p>text {n}</p></article></body>" for n in range(5)]
    assert H.extract(pages[2], H.induce(pages)) == "text 2"
    assert H.extract(pages[2], H.induce(pages[:3])) == "Read this first\n\ntext 2"  # fewer than four pages
    assert H.extract(pages[2], H.induce(pages[:3], min_pages=2)) == "text 2"
    assert H.extract(pages[2], H.induce(pages, min_pages=6)) == "Read this first\n\ntext 2"


def test_odd_pages():
    assert H.extract(None, None) == "" and H.extract("", None) == ""
    assert H.extract("just text", None) == "just text"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert H.extract(deep, H.induce([deep, deep + "x"])) == "core"
    wide = "<article>" + "".join(f"<p class=c{i}>w{i}</p><i>q</i>" for i in range(3000)) + "</article>"
    assert H.extract(wide, H.induce([wide])).startswith("w0\n\nq\n\nw1")
    assert H.extract('<article><p title="unclosed>text</p></article>', None) is not None
    assert H.extract("<article>a<script>x</article>", None) == "a"


def test_optional_end_tags():
    page = "<body>{}<article><p>the text</p></article></body>"
    for before in ("<datalist><option value=a><option value=b></datalist>", '<svg width="1" />', "<math/>", "<div><button></div>", "<object>", "<iframe src=x>", "<noscript>", "<select><option>a"):
        assert H.extract(page.format(before), None) == "the text", before
    assert H.extract("<article><p>one <svg><text>no</text></svg>two<button>no</button></p><select><option>no<option>no</select></article>", None) == "one two"


def test_names_of_whole_tokens():
    page = '<body><div class="{}"><article><p>the text</p></article></div><div class="{}">noise</div></body>'
    plain = '<body><div class="{}"><p>the text</p></div></body>'
    for name in ("content with-sidebar", "layout no-sidebar", "post ad-free", "page nav-open", "has-comments", "elementor-widget", "social-science", "sidebar"):
        assert H.extract(page.format(name, "x"), None) == "the text", name
        assert H.extract(plain.format(name), None) == "the text", name
    for name in ("ad", "cookie-notice", "site-header", "main-nav", "footer_links", "related-posts", "Sidebar-left"):
        got = H.extract(f'<body><div class="{name}"><p>noise</p></div><div><p>some longer text</p></div></body>', None)
        assert got == "some longer text", name


def test_unmarked_page_keeps_all_slots():
    body = "<p>long text of the page</p>" * 20
    page = f"<body><ul><li><a href=a>menu</a></li><li><a href=b>two</a></li></ul><div><h1>Title</h1></div><div>Lead</div><div class=x>{body}<p><a href=s>source</a></p><ol><li><a href=r>Reference</a></li></ol></div><div><p>Closing</p></div></body>"
    want = ["Title", "Lead", *["long text of the page"] * 20, "source", "Reference", "Closing"]
    assert H.extract(page, None).split("\n\n") == want


def test_simple_tree_matching():
    a, b = H.collapse(H.parse("<div><p>1</p><ul><li>a</li></ul></div>")), H.collapse(H.parse("<div><ul><li>x</li><li>y</li></ul></div>"))
    size, pairs = H.match(a, b)
    assert size == 4 and len(pairs) == 4
    H.merge(a, b)
    assert H.shape(a) == '["#","",[["div","",[["p","",[]],["ul","",[["li","",[]]]]]]]]'
    c = H.collapse(H.parse("<div><ul><li>x</li></ul><table><tr><td>1</td></tr></table></div>"))
    H.merge(a, c)
    assert [r.key[0] for r in H.in_order(a)] == ["#", "div", "p", "ul", "li", "table", "tr", "td"]
    assert H.numbers(a, c) == [0, 1, 3, 4, 5, 6, 7]


def brute_extract(pages):
    """Texts of rows (host, html) with a wrapper that is induced from all of a host's pages at once."""
    hosts = {}
    for host, html in pages:
        if html:
            hosts.setdefault(host, []).append(html)
    own = {h: H.induce(x) for h, x in hosts.items()}
    return [H.extract(html, own.get(host)) for host, html in pages]


def test_frames_against_brute_force(spark):
    """Counting by aggregation over all pages, in many tasks, gives the wrappers that one pass per host gives."""
    import random

    r = random.Random(3)
    data = []
    for n in range(160):
        host = r.choice(["a.example", "a.example", "a.example", "b.example", "c.example", f"single{n}.example"])
        extra = r.choice(["", "<div><p>Same words on this host</p></div>", f"<div><p>Other {r.randint(0, 3)}</p></div>", "<section><p>Rare part</p></section>"])
        menu = "".join(f"<li><a href=/{r.randint(0, 9)}>item {r.randint(0, 9)}</a></li>" for _ in range(4))
        body = "".join(f"<p>text {n} {r.random()}</p>" for _ in range(r.randint(1, 4)))
        mark = r.choice(["div", "div", "article"])
        data.append((n, f"http://{host}/{n}", f"<body><ul>{menu}</ul>{extra}<{mark}><h1>Title {n}</h1>{body}</{mark}><div><p>Kept by {host}</p></div></body>"))
    data += [(200 + k, *data[k][1:]) for k in range(5)]
    got = {x["page_id"]: x["text"] for x in H.extract_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(7)).collect()}
    want = brute_extract([(u.split("/")[2], h) for _, u, h in data])
    assert got == {d[0]: t for d, t in zip(data, want, strict=True)}
    assert any("Kept by" not in t for t in want) and any("Kept by" in t for t in want)


def test_frames(spark):
    data = [(n, f"http://Host.example/{n}", page(n)) for n in range(6)] + [(9, None, None), (9, "nohost", ""), (None, "http://host.example/x", page(3))]
    out = H.extract_text(spark.createDataFrame(data, "page_id long, url string, html string"))
    got = {(r["page_id"], r["url"]): r["text"] for r in out.collect()}
    assert len(got) == 9 and got[4, "http://Host.example/4"] == TEXT.format(n=4) and got[9, None] == ""
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
