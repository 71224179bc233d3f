"""HTML extraction by wrapper induction.

* A page becomes a tree of elements; a run of like siblings (same tag and class, and like elements below) is one
  iterator node.  Its shape is that tree without texts.
* Per host, the trees of all shapes are aligned by simple tree matching and merged into one, in an order that
  follows from the shapes alone.  Then the texts of all pages (exact copies once) are counted at the merged
  tree's nodes, as hashes.  A node where one text stands on at least SHARE of the pages that have the node, and on
  MIN_PAGES at least, is template with that text; other nodes are slots.  A node of which over LINKED of the
  characters are links, over all pages of the host, is a menu.
* Every page is aligned with its host's wrapper.  Template nodes with the template's text go.  What is left are
  slots.  Among them names and marks decide: slots go that lie in elements that name themselves menus, headers,
  footers, sidebars, notices, adverts, forms or comments; if the page marks an article (or main part), slots outside
  it go too; else menus go that do not stand beside a paragraph, and all other slots are the text.
* What is marked as the article is no template, even if it is the same on all pages.  If the template leaves a page
  without text, its host has copies of one page only, and nothing is template.
* Blocks are the texts between block-level tags, white space as one space, joined by two line feeds.

So a host of fewer than MIN_PAGES pages has no template, and a page that is its host's only one is judged by names
and marks alone.  All three limits are parameters of wrappers().  Shapes and texts are aggregated before they are
shuffled; shapes of a host are merged in SALTS parts first, and pages of a host with very many meet its wrapper by
broadcast (joins.looked_up), so a host with a third of all pages loads no task.

Empty table: empty result.  Null or empty html: empty text.  A url without a host counts under the host ''.
Repeated rows are extracted one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import looked_up
from .pretokens import slices
from .scratch import drop, stored

MIN_PAGES = 4
SHARE = 0.9
LINKED = 0.6
#: Parts in which a host's shapes are merged.
SALTS = 64
#: Nodes of a host's tree; beyond, a node is not added and so is a slot.
NODES = 2000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
#: Elements without article text.  One that its own end tag does not close counts as a plain element.
_SKIP = frozenset("template noscript iframe object svg select datalist optgroup option button canvas audio video".split())
_OPTION = frozenset(("option", "optgroup"))
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace semantics".split()
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption address".split())
_LISTS = frozenset("ul ol dl".split())
_GONE = frozenset("nav footer aside form head menu dialog fieldset".split())
_GONE_NAME = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|nav\w*|menus?|breadcrumbs?|sidebar|footer"
    r"|comments?|commentlist|discussion|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|widget|masthead|siteheader|pageheader|skip"
)
#: Parts that may stand beside such a word in a class or id; others (with-, no-, has-, -free, -open) change its sense.
_BESIDE = re.compile(
    r"\d*|site|page|header|main|top|bottom|left|right|primary|secondary|global|bar|box|block|list|items?|links?|area|section|wrap|wrapper|container|inner|outer|row|col|slot|unit|form|buttons?|icons?|media|posts|articles|stories|text|message|to|us"
)
_TALK = re.compile(r"comments?|commentlist|discussion|replies|disqus")
_GONE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")
#: Deeper elements join their ancestor at this depth; more runs than WIDEST under one node merge by tag.
DEEPEST, WIDEST = 200, 100
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names_gone(token: str) -> bool:
    parts = re.split("[-_]+", token.lower())
    gone = [bool(_GONE_NAME.fullmatch(x)) for x in parts]
    whole = any(gone) or bool(re.search(r"(?:^|[-_])(?:site|page)[-_]?header$", token, re.I))
    return whole and all(g or _BESIDE.fullmatch(x) for g, x in zip(gone, parts, strict=True))


class Node:
    """children: nodes and texts in order."""

    __slots__ = ("tag", "name", "kind", "children", "gone", "main", "skip", "named")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.name, self.kind, self.children = tag, "", "", []
        self.skip, self.named = tag in _SKIP, False
        self.gone, self.main = tag in _GONE, 2 if tag == "article" else 1 if tag == "main" else 0
        if attrs:
            for k, a, b, c in _ATTR.findall(attrs):
                v = a or b or c
                k = k.lower()
                if k in ("class", "id"):
                    self.name += " " + v
                    if k == "class":
                        self.kind = _DIGITS.sub("0", v)
                elif k == "role":
                    self.gone |= v.lower() in _GONE_ROLE
                    self.main = max(self.main, 1 if v.lower() == "main" else 2 if v.lower() == "article" else 0)
                elif k == "itemprop":
                    self.main = max(self.main, 3 if v.lower() == "articlebody" else 0)
                elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v):
                    self.gone = True
            if self.name and tag not in ("html", "body", "article", "main"):
                self.named = not self.gone and any(map(_names_gone, self.name.split()))
                self.gone |= self.named

    @property
    def key(self) -> tuple[str, str]:
        return self.tag, self.kind


def parse(page: str) -> Node:
    root = Node("#")
    stack, at = [root], 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            block = tag not in _INLINE
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    _unclosed(stack[i + 1 :])
                    del stack[i:]
                    break
                if not block and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack[-1].children.append(Node("#raw"))
            continue
        while stack[-1].tag in _OPTION and (tag not in _OPTION or stack[-1].tag == tag or tag == "optgroup"):
            stack.pop()
        if tag not in _INLINE and tag not in _SKIP:
            # a block ends an open paragraph; a list item, cell or definition ends its like
            ends = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t in ends:
                    del stack[i:]
                    if t == "p":
                        continue
                    break
                if t not in _INLINE:
                    break
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag not in _VOID and not (m[3] or "").endswith("/") and (len(stack) < DEEPEST or node.skip):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    _unclosed(stack)
    return root


def _unclosed(nodes: list[Node]) -> None:
    for x in nodes:
        x.skip &= x.tag in _OPTION


def squeezed(s: str) -> str:
    return " ".join(s.split())


class Run:
    """An iterator node: like siblings in a row.  nodes: those of the page (none in a host's tree)."""

    __slots__ = ("key", "nodes", "runs")

    def __init__(self, key: tuple[str, str], nodes: list[Node]) -> None:
        self.key, self.nodes = key, nodes
        self.runs: list[Run] = []


def collapse(root: Node) -> Run:
    """Tree of runs; inline elements belong to their block's text."""

    def below(node: Node) -> frozenset:
        return frozenset(c.key for c in node.children if not isinstance(c, str) and c.tag not in _INLINE and c.tag != "#raw" and not c.skip)

    top = Run(root.key, [root])
    todo = [top]
    while todo:
        run = todo.pop()
        for node in run.nodes:
            last = None
            for child in node.children:
                if isinstance(child, str) or child.tag in _INLINE or child.tag == "#raw" or child.skip:
                    continue
                if last is not None and last.key == child.key and below(last.nodes[-1]) == below(child):
                    last.nodes.append(child)
                    continue
                same = None
                if node is not run.nodes[0] or len(run.runs) >= WIDEST:
                    same = next((r for r in run.runs if r.key == child.key), None)
                if same is None and len(run.runs) >= WIDEST:
                    same = next((r for r in run.runs if r.key[0] == child.tag), None)
                if same is not None:
                    same.nodes.append(child)
                    last = same
                else:
                    last = Run(child.key, [child])
                    run.runs.append(last)
        todo.extend(run.runs)
    return top


def in_order(top: Run) -> list[Run]:
    out, todo = [], [top]
    while todo:
        run = todo.pop()
        out.append(run)
        todo.extend(reversed(run.runs))
    return out


def shape(run: Run) -> str:
    def bare(r: Run) -> list:
        return [*r.key, [bare(x) for x in r.runs]]

    return json.dumps(bare(run), ensure_ascii=False, separators=(",", ":"))


def tree_of(text: str) -> Run:
    def whole(x: list) -> Run:
        run = Run((x[0], x[1]), [])
        run.runs = [whole(y) for y in x[2]]
        return run

    return whole(json.loads(text))


def hashed(text: str) -> int:
    """63 bits; 0 stands for no text."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1 or 1


def match(a: Run, b: Run) -> tuple[int, list[tuple[Run, Run]]]:
    """Simple tree matching: the largest number of pairs that keeps order and descent, and the pairs."""
    if a.key != b.key:
        return 0, []
    m, n = len(a.runs), len(b.runs)
    w = [[match(x, y) if x.key == y.key else (0, []) for y in b.runs] for x in a.runs]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1][0])
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if w[i - 1][j - 1][0] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1][0]:
            pairs += w[i - 1][j - 1][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def merge(tree: Run, other: Run) -> None:
    """Adds what other has more to the tree, each subtree after the sibling that it follows."""
    pairs = match(tree, other)[1]
    of = {id(b): a for a, b in pairs}
    room = NODES - len(in_order(tree))
    for a, b in pairs:
        at = 0
        for child in b.runs:
            if id(child) in of:
                at = a.runs.index(of[id(child)]) + 1
            elif len(a.runs) < WIDEST and (size := len(in_order(child))) <= room:
                a.runs.insert(at, tree_of(shape(child)))
                at, room = at + 1, room - size


def numbers(tree: Run, other: Run) -> list[int]:
    """Number of the tree's node for each of other's nodes in order; -1 for none."""
    no = {id(r): k for k, r in enumerate(in_order(tree))}
    of = {id(b): no[id(a)] for a, b in match(tree, other)[1]}
    return [of.get(id(r), -1) for r in in_order(other)]


def measured(node: Node, out: dict[int, tuple[str, int, int]] | None = None, link: bool = False) -> dict[int, tuple[str, int, int]]:
    """Of each element below: its text as it stands, the signs of its texts, and how many of them are links."""
    out = {} if out is None else out
    parts, n, k = [], 0, 0
    if not node.skip:
        for c in node.children:
            if isinstance(c, str):
                m = len(squeezed(c))
                parts.append(c)
                n, k = n + m, k + (m if link else 0)
            elif c.tag != "#raw":
                measured(c, out, link or c.tag == "a")
                text, m, l = out[id(c)]
                parts.append(text)
                n, k = n + m, k + l
    text = "".join(parts)
    out[id(node)] = (text if node.tag in _INLINE else f" {text} ", n, k)
    return out


def _text(run: Run, info: dict[int, tuple[str, int, int]]) -> str:
    return squeezed(" ".join(info[id(x)][0] for x in run.nodes))


def signature(page: str) -> tuple[str, list[int], list[int], list[int]]:
    """A page's shape and, of its nodes in order, hash of the text (0: none), signs and linked signs."""
    root = parse(page)
    info, top = measured(root), collapse(root)
    hashes, signs, links = [], [], []
    for run in in_order(top):
        t = _text(run, info)
        hashes.append(hashed(t) if t else 0)
        signs.append(sum(info[id(x)][1] for x in run.nodes))
        links.append(sum(info[id(x)][2] for x in run.nodes))
    return shape(top), hashes, signs, links


class Wrapper:
    """A host's tree; fixed: number of a template node to the hash of its text; menus: numbers of menus."""

    def __init__(self, tree: str, fixed: dict[int, int], menus: set[int]) -> None:
        self.tree, self.fixed, self.menus = tree_of(tree), fixed, menus
        self._known: dict[str, list[int]] = {}

    def numbers(self, top: Run) -> list[int]:
        key = shape(top)
        if key not in self._known:
            if len(self._known) >= 256:
                self._known.clear()
            self._known[key] = numbers(self.tree, top)
        return self._known[key]


def induce(pages: list[str], min_pages: int = MIN_PAGES, share: float = SHARE, linked: float = LINKED) -> Wrapper:
    """The wrapper of a host's pages, as wrappers() makes it."""
    signs = list({(s, tuple(h), tuple(n), tuple(k)) for s, h, n, k in map(signature, pages)})
    shapes = sorted({x[0] for x in signs}, key=hashed)
    parts: dict[int, Run] = {}
    for x in shapes:
        own = parts.setdefault(hashed(x) % SALTS, tree_of(x))
        merge(own, tree_of(x))
    trees = [parts[k] for k in sorted(parts)]
    for x in trees[1:]:
        merge(trees[0], x)
    tree = shape(trees[0])
    count: dict[int, dict[int, int]] = {}
    size: dict[int, list[int]] = {}
    for x, h, n, k in signs:
        for no, a, b, c in zip(numbers(trees[0], tree_of(x)), h, n, k, strict=True):
            if no >= 0 and a:
                count.setdefault(no, {}).setdefault(a, 0)
                count[no][a] += 1
                own = size.setdefault(no, [0, 0])
                own[0], own[1] = own[0] + b, own[1] + c
    fixed = {}
    for no, c in count.items():
        n, h = max((n, h) for h, n in c.items())
        if n >= min_pages and n >= share * sum(c.values()):
            fixed[no] = h
    return Wrapper(tree, fixed, {no for no, (n, k) in size.items() if k > linked * n})


def blocks_of(node: Node, dropped: set[int]) -> list[str]:
    """Texts between block-level tags."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        t = squeezed(htmllib.unescape("".join(text)))
        if t:
            out.append(t)
        text.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            text.append(x)
        elif x.tag == "#raw" or x.skip or id(x) in dropped or x is not node and x.gone:
            if x.tag not in _INLINE and x.tag != "#raw" and not x.skip:
                flush()
        elif x.tag == "br":
            text.append(" ")
        elif x.tag in _INLINE:
            todo.extend(reversed(x.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def _template(top: Run, wrapper: Wrapper, info: dict[int, tuple[str, int, int]]) -> tuple[set[int], dict[int, bool]]:
    """Elements that are template; and of the others that the wrapper knows, whether they are menus."""
    no = dict(zip(map(id, in_order(top)), wrapper.numbers(top), strict=True))
    dropped: set[int] = set()
    menus: dict[int, bool] = {}
    todo = [top]
    while todo:
        run = todo.pop()
        k = no[id(run)]
        if k >= 0:
            menus.update((id(x), k in wrapper.menus) for x in run.nodes)
        if k in wrapper.fixed and hashed(_text(run, info)) == wrapper.fixed[k]:
            if any(x.main for x in run.nodes):
                continue
            if not any(x.main for r in in_order(run) for x in r.nodes):
                dropped.update(map(id, run.nodes))
                continue
        todo.extend(run.runs)
    return dropped, menus


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    if not page:
        return ""
    root = parse(page)
    if wrapper is not None:
        text = _extracted(root, *_template(collapse(root), wrapper, measured(root)))
        if text:
            return text
        root = parse(page)
    return _extracted(root, set(), {})


def _extracted(root: Node, dropped: set[int], menus: dict[int, bool]) -> str:
    _release(root, dropped)
    places: list[tuple[int, Node]] = []
    todo = [root]
    while todo:
        x = todo.pop()
        if x.gone or x.skip or id(x) in dropped:
            continue
        if x.main:
            places.append((x.main, x))
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str) and c.tag != "#raw")
    if places:
        # the most telling mark that holds text; articles side by side all count, one inside another once
        for level in (3, 2, 1):
            found, inside = [], set()
            for k, x in places:
                if k == level and id(x) not in inside:
                    found += blocks_of(x, dropped)
                    inside.update(_below(x))
            if found:
                return "\n\n".join(found)
    _drop_menus(root, dropped, menus)
    return "\n\n".join(blocks_of(root, dropped))


def _release(root: Node, dropped: set[int]) -> None:
    """Elements dropped for their name alone count again if nothing outside them is marked, and they hold a
    mark with as much text as there is outside, or most of the text (comments: all of it)."""
    while True:
        free, marked, tops = _weighed(root, dropped)
        if marked:
            return
        back = False
        for x in tops:
            x.gone = False
            w, m, _ = _weighed(x, dropped)
            talk = any(_TALK.fullmatch(q) for t in x.name.lower().split() for q in re.split("[-_]+", t))
            if w and (m >= free and m or w > free and not (talk and free)):
                back = True
            else:
                x.gone = True
        if not back:
            return


def _weighed(node: Node, dropped: set[int]) -> tuple[int, int, list[Node]]:
    """Signs of text that stays below node, those inside a mark, and the topmost elements dropped by name."""
    free = marked = 0
    tops = []
    todo: list[tuple] = [(node, False)]
    while todo:
        x, mark = todo.pop()
        if isinstance(x, str):
            n = len(squeezed(x))
            free += n
            marked += n if mark else 0
        elif x.tag == "#raw" or x.skip or id(x) in dropped:
            continue
        elif x.gone:
            if x.named:
                tops.append(x)
        else:
            mark = mark or x.main > 0
            todo.extend((c, mark) for c in x.children)
    return free, marked, tops


def _below(node: Node) -> set[int]:
    out, todo = set(), [node]
    while todo:
        x = todo.pop()
        out.add(id(x))
        todo.extend(c for c in x.children if not isinstance(c, str))
    return out


def _drop_menus(root: Node, dropped: set[int], menus: dict[int, bool]) -> None:
    """Adds menus to dropped, unless they stand beside a paragraph.  An element that the wrapper does not know is one if
    over LINKED of its own signs are links."""
    size: dict[int, tuple[int, int]] = {}
    order: list[tuple[Node, bool]] = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, link = todo.pop()
        if x.tag == "#raw" or x.skip or x.gone or id(x) in dropped:
            continue
        link = link or x.tag == "a"
        order.append((x, link))
        todo.extend((c, link) for c in x.children if not isinstance(c, str))
    for x, link in reversed(order):
        n = k = 0
        for c in x.children:
            if isinstance(c, str):
                m = len(squeezed(c))
                n, k = n + m, k + (m if link else 0)
            else:
                m, l = size.get(id(c), (0, 0))
                n, k = n + m, k + l
        size[id(x)] = n, k
    todo = [(root, False)]
    while todo:
        x, beside = todo.pop()
        n, k = size.get(id(x), (0, 0))
        if not n or x.tag in _TEXTUAL or x.tag in _INLINE:
            continue
        if menus.get(id(x), k > LINKED * n) and not beside and x.tag not in ("#", "html", "body"):
            dropped.add(id(x))
            continue
        if x.tag in _LISTS:
            continue
        inner = [c for c in x.children if not isinstance(c, str)]
        own = any(c.tag == "p" and size.get(id(c), (0, 0))[0] > size.get(id(c), (0, 0))[1] for c in inner)
        todo.extend((c, own) for c in inner)


# ---- plan ----------------------------------------------------------------------------------------------


def _signed(batches):
    """host, key of the shape, the shape where a task first meets it, and the node lists of each page."""
    seen: set[tuple[str, int]] = set()
    for b in slices(batches, 1):
        cols: list[list] = [[] for _ in range(6)]
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text, hashes, signs, links = signature(page)
            key = hashed(text)
            new = (host, key) not in seen
            if new and len(seen) >= 100_000:
                seen.clear()
            seen.add((host, key))
            for c, v in zip(cols, (host, key, text if new else None, hashes, signs, links), strict=True):
                c.append(v)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "key", "shape", "hashes", "signs", "links"])


def _merging(batches):
    """(host, part, tree) of rows (host, part, tree) in the order in which they are merged."""
    at, tree = None, None
    for b in batches:
        for host, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (host, part) != at:
                if tree is not None:
                    yield _row(*at, tree)
                at, tree = (host, part), tree_of(text)
            else:
                merge(tree, tree_of(text))
    if tree is not None:
        yield _row(*at, tree)


def _row(host: str, part: int, tree: Run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([part], pa.int32()), pa.array([shape(tree)])], ["host", "part", "tree"])


def _aligned(batches):
    """(host, key, nodes) of (host, key, shape, tree)."""
    known: dict[str, Run] = {}
    for b in batches:
        hosts, keys, shapes, trees = (c.to_pylist() for c in b.columns)
        nodes = []
        for s, t in zip(shapes, trees, strict=True):
            if t not in known:
                if len(known) >= 256:
                    known.clear()
                known[t] = tree_of(t)
            nodes.append(numbers(known[t], tree_of(s)))
        yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(keys, pa.int64()), pa.array(nodes, pa.list_(pa.int32()))], ["host", "key", "nodes"])


def host_trees(shapes: DataFrame) -> DataFrame:
    """(host, tree) of rows (host, key, shape), merged in parts and then part by part."""
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "host string, part int, tree string"
    rows = shapes.select("host", F.pmod("key", F.lit(SALTS)).cast("int").alias("part"), "key", F.col("shape").alias("tree"))
    parts = rows.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "key").select("host", "part", "tree").mapInArrow(_merging, kind)
    whole = parts.repartition(tasks, "host").sortWithinPartitions("host", "part").select("host", F.lit(0).alias("part"), "tree").mapInArrow(_merging, kind)
    return whole.select("host", "tree")


def wrappers(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, linked: float = LINKED) -> DataFrame:
    """(host, tree, fixed, hashes, menus, pages) from rows (host, html)."""
    given = pages.where("html is not null and html != ''").select("host", "html")
    schema = "host string, key long, shape string, hashes array<long>, signs array<int>, links array<int>"
    signed = stored(given.mapInArrow(_signed, schema), "page-shapes")
    distinct = signed.groupBy("host", "key", "hashes", "signs", "links").agg(F.count(F.lit(1)).alias("copies"))  # copies count once
    distinct = stored(distinct, "distinct-pages")
    shapes = stored(signed.groupBy("host", "key").agg(F.max("shape").alias("shape")), "shapes")
    trees = stored(host_trees(shapes), "host-trees")
    nodes = shapes.join(trees, "host").select("host", "key", "shape", "tree").mapInArrow(_aligned, "host string, key long, nodes array<int>")
    times = distinct.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.join(times, ["host", "key"]), "aligned")

    total = distinct.count()
    each = looked_up(distinct.select("host", "key", "hashes", "signs", "links"), nodes, ["host", "key"], "n", total)
    each = each.select("host", F.explode(F.arrays_zip("nodes", "hashes", "signs", "links")).alias("x")).select("host", "x.*").where("nodes >= 0 and hashes != 0")
    texts = each.groupBy("host", "nodes", "hashes").agg(F.count(F.lit(1)).alias("c"), F.sum("signs").alias("signs"), F.sum("links").alias("links"))
    stats = texts.groupBy("host", "nodes").agg(
        F.max(F.struct("c", "hashes")).alias("top"), F.sum("c").alias("n"), F.sum("signs").alias("signs"), F.sum("links").alias("links")
    )
    same = (F.col("top.c") >= min_pages) & (F.col("top.c") >= F.lit(share) * F.col("n"))
    menu = F.col("links") > F.lit(linked) * F.col("signs")
    kinds = stats.groupBy("host").agg(  # as many as a tree has nodes at most
        F.collect_list(F.when(same, F.struct("nodes", "top.hashes"))).alias("fixed"), F.collect_list(F.when(menu, F.col("nodes"))).alias("menus")
    )
    sizes = given.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    out = trees.join(kinds, "host", "left").join(sizes, "host").select(
        "host", "tree", F.col("fixed.nodes").alias("fixed"), F.col("fixed.hashes").alias("hashes"), "menus", "pages"
    )
    out = stored(out, "wrappers")
    drop(signed, distinct, shapes, trees, nodes)
    return out


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, share: float = SHARE, linked: float = LINKED,
) -> DataFrame:
    """id, url and text of every row."""
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(host).alias("host"))
    known: dict[str, Wrapper] = {}

    def run(batches):
        for b in slices(batches, 2):
            out = []
            hosts, html, trees, fixed, hashes, menus = (b.column(c) for c in ("host", "html", "tree", "fixed", "hashes", "menus"))
            for i, h in enumerate(hosts.to_pylist()):
                own = None
                if trees[i].is_valid:
                    if h not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[h] = Wrapper(trees[i].as_py(), dict(zip(fixed[i].as_py() or (), hashes[i].as_py() or (), strict=True)), set(menus[i].as_py() or ()))
                    own = known[h]
                out.append(extract(html[i].as_py(), own))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    own = wrappers(rows, min_pages, share, linked)
    total = own.agg(F.sum("pages")).first()[0] or 0
    joined = looked_up(rows, own, ["host"], "pages", total)
    return joined.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
