"""Main-text extraction from HTML by composite text density.

The page is parsed into a light DOM. Boilerplate elements are cut first (navigation, headers, footers, asides,
forms, scripts, styles, and blocks whose role, class or id names a menu, advert, notice, sidebar or comment list).
On what is left, every node's composite density is the characters per tag adjusted by its share of link text; a
node's density sum is the sum of its children's densities (inline children, such as a bold phrase, are part of the
node's own text and not of its structure). The subtree of largest density sum gives the threshold,
the smallest density on its path up to the body. The result is the subtree and every other subtree at or above the
threshold; one inside an ``article`` or ``main`` element is extended to the whole (outermost) element. Where the body
itself has the largest density sum, it is the result.

Defined cases: null and empty html give an empty text; broken markup is repaired as browsers do in the usual cases
(unclosed p, li, b; stray end tags are ignored); nesting is followed up to any depth without recursion; repeated
rows and ties are treated alike (the first of equal density sums wins); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

#: Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template title head nav header footer aside form iframe object embed svg canvas button select textarea input label "
    "dialog menu audio video map math fieldset datalist option xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names (split at anything but letters and digits, and at humps) that mark boilerplate.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup signin login share sharing social related recommended recommendations comment comments disqus respond replies "
    "widget toolbar pagination pager skip hidden tagcloud alert alerts commentlist commentform topbar".split()
)
KEPT = frozenset(("html", "body", "article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "link_chars", "tags", "link_tags", "density", "density_sum", "outer")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        #: the outermost article or main around the node, itself included
        self.outer = (parent.outer if parent is not None else None) or (self if tag in ("article", "main") else None)
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.density_sum = 0.0


def is_boilerplate(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is cut before densities are computed; ``inside``: an article or main element is open, where a
    class of that name is the article's heading."""
    if tag in KEPT:
        return False
    if tag in DROPPED:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in WORD.findall(value)}
            if words & DROPPED_WORDS or ("header" in words and not inside):
                return True
    return False


class Path:
    """The open elements, outermost first, with the places of each tag and of the blocks among them, so that no tag needs
    a walk over elements that stay open."""

    def __init__(self):
        self.open = [Node("#root", None)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def now(self) -> Node:
        return self.open[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def close(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 (the root's) if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def end(self, tag: str) -> None:
        """An end tag: closes its element; that of an inline element does not reach past a block; others are ignored."""
        at = self.last(tag)
        if at and (tag not in INLINE or at > self.blocks[-1]):
            self.close(at)

    def begin(self, tag: str) -> None:
        """What a start tag closes by itself: a paragraph before a block, the item, cell or row before it in its list or
        table (a row also closes the cells and rows that hold it)."""
        if tag in CLOSES_P:
            if self.open[self.blocks[-1]].tag == "p":
                self.close(self.blocks[-1])
        elif tag in SAME_CLOSES:
            scope = max((self.last(x) for x in SCOPES.get(tag, ())), default=0)
            same = [x for x in SAME_CLOSES[tag] if self.last(x) > scope]
            if same and tag == "tr":
                self.close(min(self.places[x][bisect(self.places[x], scope)] for x in same))
            elif same:
                self.close(max(map(self.last, same)))


class Cut:
    """Open elements inside one that is left out."""

    def __init__(self):
        self.open: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, tag: str) -> None:
        self.open.append(tag)
        self.count[tag] += 1

    def pop(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def clear(self) -> None:
        self.open.clear()
        self.count.clear()


def parse(source: str) -> Node:
    """Light DOM: text leaves are strings, boilerplate is left out, the root's only fixed child is none."""
    path, cut, at = Path(), Cut(), 0
    root = path.now
    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at and not cut.open:
            path.now.children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not cut.open:
                path.now.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if not cut.open:
                path.end(tag)
            elif cut.count[tag]:
                cut.end(tag)
            elif tag in ("body", "html", "article", "main"):
                cut.clear()  # an unclosed cut element ends with the article or page around it
                path.end(tag)
            continue
        attributes = m[3]
        closed = attributes.endswith("/") and tag not in RAW
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if cut.open:
            if tag in ("article", "main") and not cut.count["article"] and not cut.count["main"] and cut.open[0] in ("p", "li", "input", "option", "label"):
                cut.clear()
            else:
                if tag not in VOID and not closed:
                    if tag in ("p", "li", "option", "dt", "dd") and cut.open[-1] == tag and len(cut.open) > 1:
                        cut.pop()
                    cut.push(tag)
                continue
        path.begin(tag)
        now = path.now
        if is_boilerplate(tag, attributes, now.outer is not None):
            if tag not in VOID and not closed:
                cut.push(tag)
            else:
                now.children.append(Node(tag, now))
            continue
        child = Node(tag, now)
        now.children.append(child)
        if tag not in VOID and not closed:
            path.push(child)
    if at < len(source) and not cut.open:
        tail = source[at:]
        path.now.children.append(html.unescape(tail.split("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", tail) else tail))
    return root


def measure(root: Node) -> list[Node]:
    """Characters, tags and densities of every node, bottom-up; returns the nodes in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(SPACE.sub(" ", c).strip())
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    body = next((n for n in order if n.tag == "body"), root)
    page_ratio = body.link_chars / max(1, body.chars)
    for node in order:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * lc + page_ratio * c + math.e)
        node.density = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001))) if base > 1 else c / t
    for node in order:
        node.density_sum = sum(x.density for x in node.children if isinstance(x, Node) and x.tag not in INLINE)
    return order


def select(root: Node) -> list[Node]:
    """The content subtrees in page order."""
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    best = max(order, key=lambda n: n.density_sum)
    if not best.chars:
        return [root] if root.chars else []
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    if best in (root, body) or best.tag == "html":
        return [best]
    threshold = min(n.density for n in path)
    on_path = set(map(id, path))
    found: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        if node is best or (node.density >= threshold and id(node) not in on_path and node.chars):
            top = node.outer or node
            if not found or found[-1] is not top:
                found.append(top)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def blocks_of(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks in page order, white space turned into one space and trimmed; empty ones are left out."""
    held: list[str] = []
    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                held.append(item)
            elif item is None or (item.tag not in INLINE and not item.children):
                if text := SPACE.sub(" ", "".join(held)).strip():
                    yield text
                held = []
            else:
                block = item.tag not in INLINE
                if block:
                    stack.append(None)
                stack.extend(reversed(item.children))
                if block:
                    stack.append(None)
        if text := SPACE.sub(" ", "".join(held)).strip():
            yield text
        held = []


def main_text(source: str | None) -> str:
    """Main text of one page; empty if there is none."""
    return " ".join(blocks_of(select(parse(source)))) if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars (code points); a map-only pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, TEXT_SCHEMA)
