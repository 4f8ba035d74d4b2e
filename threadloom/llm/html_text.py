"""Main text of web pages by tree scoring.

The page is read into a tree of elements; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out. Every paragraph scores by its length and commas and passes its points to its parent, and half of them to
the grandparent; a container's score is discounted by the share of its text that lies in links. From the best container the text
goes up to the article or main element around it, or else to the highest element of mostly unlinked text: all blocks of the article
count, and those beside it in branches that are not mostly links, whatever their size.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, string_column

# A quote belongs to an attribute's value only right after "="; one that is never closed is a character like others.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>\x00]*)((?:(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=))*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("template svg math select head nav header footer aside form button menu dialog canvas object audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY_BLOCK = frozenset(["p"])
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div article section body main blockquote td".split())
CELLS = frozenset("table td th".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

# Words in class, id and role that mark what is not the article.
JUNK = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments disqus reply replies respond widget toolbar pagination pager "
    "skip contentinfo complementary search".split()
)
#: Beside such a word in one class, id or role, these change nothing ("site-header"); with any other word it is no mark ("has-sidebar").
PLAIN = frozenset(
    "site page main top bottom left right global primary secondary box bar block section list wrapper wrap container inner outer area "
    "unit slot links buttons item items form holder row col column panel text".split()
)
OTHERS = frozenset("comment comments disqus reply replies respond related recommended".split())
ALLOWED = frozenset("article body main html".split())
#: Beside words in OTHERS or TAILS these change nothing either ("user-comments", "post-footer"); a "post-header" holds the title.
WHOSE = frozenset("user users reader readers visitor visitors guest guests post posts article articles entry story blog".split())
TAILS = frozenset("footer share sharing social sidebar nav navigation newsletter subscribe subscription ad ads advert adverts promo".split())
#: Left out unless the page's text is in it (forms, hidden wrappers); in any case; by class, id or role; by one that marks other texts
#: (readers', related ones).
WRAP, HARD, SOFT, OTHER = 4, 3, 2, 1
#: Characters of paragraphs that a form or hidden element must hold to be the page's text: a form of its own says less.
LEAST_WRAPPED = 200


class Node:
    """An element. points, text and linked are sums for scoring: points, characters, and characters in links."""

    __slots__ = ("tag", "parent", "children", "junk", "points", "text", "linked")

    def __init__(self, tag: str, parent, junk: int):
        self.tag, self.parent, self.children, self.junk = tag, parent, [], junk
        self.points, self.text, self.linked = 0.0, 0, 0


def marked(value: str) -> int:
    """SOFT or OTHER if a class, id or role consists of words in JUNK, and at most words in PLAIN beside them; else 0."""
    kind = 0
    for name in value.split():
        words = WORDS.findall(name)
        found = [w for w in words if w in JUNK]
        whose = WHOSE if not OTHERS.isdisjoint(found) or not TAILS.isdisjoint(found) else ()
        if found and all(w in JUNK or w in PLAIN or w in whose for w in words):
            kind = max(kind, SOFT if OTHERS.isdisjoint(found) else OTHER)
    return kind


def is_junk(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return WRAP if tag == "form" else HARD
    if not attributes or attributes.isspace():
        return 0
    kind = 0
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return WRAP
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return WRAP
        if name == "aria-hidden" and value == "true":
            return WRAP
        if name in ("class", "id", "role") and tag not in ALLOWED:
            kind = max(kind, marked(value))
    return kind


def rescue(root: Node) -> None:
    """Elements left out by class, id or role stay if they hold a main element, most of the page's paragraph text, or an article.
    Where an article or main element stands outside all of them, they do not stay for an article alone, nor readers' comments and
    related texts for their length. Forms and hidden elements stay only if nothing of an article stands outside and they hold a main
    element or most of the paragraph text: some pages are one form, or shown by a script. What is within an element that stays is judged in turn."""
    size, holds = {}, {}  # by element: paragraph characters within, and which of main, article it is or holds
    order, stack = [], [(root, False, False)]
    while stack:
        node, in_p, in_article = stack.pop()
        in_p, in_article = in_p or node.tag == "p", in_article or node.tag in ("article", "main")
        order.append((node, in_p, in_article))
        size[id(node)] = sum(len(x) for x in node.children if in_p and isinstance(x, str) and not x.isspace())
        holds[id(node)] = {node.tag} & {"main", "article"}
        stack.extend((x, in_p, in_article) for x in node.children if not isinstance(x, str) and x.junk != HARD)
    own = {id(node): (size[id(node)], in_article) for node, _, in_article in order}
    for node, _, _ in reversed(order[1:]):
        size[id(node.parent)] += size[id(node)]
        holds[id(node.parent)] = holds[id(node.parent)] | holds[id(node)]
    total, outside, found = size[id(root)], False, [root]
    while found:
        # Read what is in no such element any more, up to the outermost ones within it.
        outer, stack = [], found
        while stack:
            node = stack.pop()
            chars, in_article = own[id(node)]
            outside = outside or (chars > 0 and in_article)
            for x in node.children:
                if not isinstance(x, str) and x.junk != HARD:
                    (outer if x.junk else stack).append(x)
        main = lambda x: "main" in holds[id(x)]
        enough = lambda x: x.junk != WRAP or size[id(x)] >= LEAST_WRAPPED
        most = lambda x: 2 * size[id(x)] > total and enough(x) and not (outside and x.junk in (OTHER, WRAP))
        article = lambda x: "article" in holds[id(x)] and not outside and x.junk != WRAP
        found = [x for x in outer if (main(x) and not (outside and x.junk == WRAP)) or article(x) or most(x)]
        for x in found:
            x.junk = 0


class _Open:
    """Elements that are open, outermost first, and for every name where they stand."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks, self.solid, self.cells = [root], {}, [0], [0], []

    @property
    def last(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCKS:
            self.blocks.append(at)
        if node.tag not in INLINE:
            self.solid.append(at)
        if node.tag in CELLS:
            self.cells.append(at)

    def cut(self, at: int) -> None:
        """End the element at a place, and all within it."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.solid, self.cells):
            while places and places[-1] >= at:
                places.pop()

    def close(self, tag: str) -> None:
        """An end tag ends the last such element; an inline one not beyond a block, p, li and div not beyond a table or cell."""
        at = (self.places.get(tag) or [0])[-1]
        if not at or (tag in INLINE and self.blocks[-1] > at) or (tag in ("p", "li", "div") and self.cells and self.cells[-1] > at):
            return
        self.cut(at)

    def begin(self, tag: str) -> None:
        """A block begins: an open paragraph ends, as do items of the same list or row, and headings where a heading begins."""
        ends = SAME_ENDS.get(tag, ())
        while (at := self.solid[-1]) and ((x := self.nodes[at].tag) in ENDED_BY_BLOCK or x in ends or (tag in HEADINGS and x in HEADINGS)):
            self.cut(at)


def parse(page: str) -> Node:
    """The page as a tree. Text stands in children as str, its character references still coded; <br> is a space."""
    root = Node("html", None, 0)
    open_, i, soft = _Open(root), 0, False
    while i < len(page):
        m = TAG.search(page, i)
        if m is None:
            open_.last.children.append(page[i:])
            break
        if m.start() > i:
            open_.last.children.append(page[i : m.start()])
        i = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            open_.last.children.append(" ")
        if tag in ("br", "wbr", "html"):
            continue
        if closing:
            open_.close(tag)
            continue
        empty = m[3].rstrip().endswith("/")
        if tag in RAW:
            if not empty or tag in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, i)
                i = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            open_.begin(tag)
        node = Node(tag, open_.last, is_junk(tag, m[3]))
        soft = soft or node.junk in (SOFT, OTHER, WRAP)
        open_.last.children.append(node)
        if tag not in VOID and not (empty and tag not in BLOCKS and tag not in INLINE):
            open_.push(node)
    if soft:
        rescue(root)
    return root


def _without_soft(root: Node) -> Node:
    """The tree with what class, id or role had left out, but for other texts."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.junk = 0 if node.junk == SOFT else node.junk
        stack.extend(x for x in node.children if isinstance(x, Node))
    return root


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """Blocks of text outside junk, in page order: (element, text, characters in links)."""
    out, buffer = [], []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            out.append((owner, text, min(linked, len(text))))
        buffer.clear()
        linked = 0

    stack = [(root, iter(root.children), root, False)]
    while stack:
        node, rest, owner, in_link = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCKS:
                flush(owner)
            continue
        if isinstance(child, str):
            buffer.append(child)
            if in_link:
                linked += len(child.strip())
        elif child.junk:
            if child.tag in BLOCKS:
                flush(owner)
        elif child.tag in BLOCKS:
            flush(owner)
            stack.append((child, iter(child.children), child, in_link))
        else:
            stack.append((child, iter(child.children), owner, in_link or child.tag == "a"))
    flush(root)
    return out


def points_of(text: str) -> float:
    """Points of a block: its commas, and its length up to a bound."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)


def sums(root: Node, found: list[tuple[Node, str, int]]) -> list[Node]:
    """Fill in points, text and linked of all elements, from the leaves up; returns the elements, parents first. A block gives its
    points to the container around it and half of them to that one's parent, its characters to all elements that hold it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.points, node.text, node.linked = 0.0, 0, 0
        order.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    for owner, text, linked in found:
        owner.text += len(text)
        owner.linked += linked
        holder = owner if owner.tag in CONTAINERS or owner.parent is None else owner.parent
        points = points_of(text)
        holder.points += points
        if holder.parent is not None:
            holder.parent.points += points / 2
    for node in reversed(order[1:]):
        node.parent.text += node.text
        node.parent.linked += node.linked
    return order


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by newlines, empty if there is none. Time grows with the page's length alone."""
    if not page:
        return ""
    root = parse(page)
    found = blocks(root) or blocks(_without_soft(root))
    if not found:
        return ""
    order = sums(root, found)
    best = max(order, key=lambda x: x.points * (1 - x.linked / x.text) if x.text else 0.0)
    while best.tag not in CONTAINERS and best.parent is not None:
        best = best.parent
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    # The article: all of the outermost article element, or of the best container where there is none.
    whole = max((i for i, x in enumerate(path) if x.tag == "article"), default=0)
    named = max((i for i, x in enumerate(path) if x.tag in ("article", "main") and (i == whole or 2 * x.linked < x.text)), default=None)
    top = named if named is not None else max((i for i, x in enumerate(path) if 2 * x.linked < x.text), default=0)
    top = min(max(top, whole) + 1, len(path) - 1)
    wholly, along = path[whole], {id(x) for x in path[whole + 1 : top + 1]}
    # From the top down: in the article, or beside it in a branch that is not mostly links.
    inside: dict[int, bool] = {}
    for x in order:
        if x is wholly or id(x) in along:
            inside[id(x)] = True
        elif x.parent is None:
            inside[id(x)] = False
        elif id(x.parent) in along:
            inside[id(x)] = 2 * x.linked < x.text
        else:
            inside[id(x)] = inside[id(x.parent)]
    return "\n".join(text for owner, text, _ in found if inside[id(owner)])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points). A null or empty page, or one without an article, has
    an empty text. One row per row; other columns are left out."""

    def f(batch: pa.RecordBatch):
        texts = [main_text(x.as_py()) for x in string_column(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select("page_id", "url", "html"), f, "page_id long, url string, text string, n_chars long")
