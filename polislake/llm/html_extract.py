"""Main text of web pages by composite text density.

A page becomes a tree of block elements; inline elements count as tags of the
block around them, and each run of bare text beside child blocks is a block of
its own. A node's composite density weighs its characters per tag by
how much of it is links, as compared with the whole body. The subtree with the
largest sum of child densities is the main text; the least density on its path
to the body is the threshold, and further subtrees that reach it are kept too,
each again by its largest sum; so is bare text that the article around the main
text holds itself. Scripts, menus, buttons and hidden elements are cut while
reading. Other marked blocks (headers, footers, asides, forms, and class, id or
role words of notices, adverts, comments of readers and the like) are cut before
densities are taken, unless they turn out to be what is around the article: a
block with at least half of the page's unlinked text stays if it is a form, if it
is an ``article`` or ``main``, if its mark is part of a compound such as
``with-sidebar`` or ``tag-advertising``, or if it holds an unmarked ``article``,
``main`` or ``h1``; and where nothing would be left, any block with half of the
text stays. Of a ``header`` inside an article its ``h1`` and ``h2`` stay.

Pages are read where they lie, one row in, one row out, nothing is shuffled;
reading is one pass over the tags, so a long page costs time in proportion.

Defined cases: a null or empty page, or one without text, has an empty text; an
unclosed element ends with its parent, unclosed scripts and comments end with
the page; rows that share an id are read one by one; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from polislake.llm.common import annotate

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title xmp iframe noembed noframes".split())
CUT = RAW | set("head nav button select option svg canvas object audio video map dialog menu".split())
#: Cut unless they are around the article.
MARKED = set("header footer aside form".split())
BLOCK = set(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
CLOSES_P = BLOCK - set("html body td th tr tbody thead tfoot caption summary".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html article section div main td th blockquote".split())
#: Words of class, id and role values that mark what is not the article.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu menubar modal nav navbar"
    " navigation newsletter notice notification pager pagination paywall popup promo promotion related recommended respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget"
    " complementary contentinfo search".split()
)
#: First words of compounds that say something about the page or its topic, not what the element is.
TOPICAL = set("no not with without has is hide show tag category cat topic type format".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: The name of a run of bare text.
TEXT = "#text"


class Node:
    """A block element: its parts in order, texts and nodes, and what was counted in it."""

    __slots__ = ("name", "mark", "parts", "tags", "link_tags", "chars", "link_chars", "density", "total")

    def __init__(self, name: str, mark: int = 0) -> None:
        self.name, self.mark, self.parts = name, mark, []
        self.tags = self.link_tags = self.chars = self.link_chars = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


#: How sure a mark is; what is hidden goes in any case.
WEAK, STRONG, HIDDEN = 1, 2, 3


def _mark(attributes: str) -> int:
    """The mark that an element's attributes give it, 0 for none."""
    mark = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in unescape(value).lower().split():
                found = _WORD.findall(token)
                if not BOILERPLATE.isdisjoint(found):
                    mark = max(mark, WEAK if len(found) > 2 or found[0] in TOPICAL else STRONG)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return HIDDEN
    return mark


def parse(html: str) -> Node:
    """The tree of blocks without what is cut; its root stands for the body."""
    root = Node("body")
    # Open elements: name, its node if it is a block, whether it cuts, whether it is a link.
    stack: list[tuple[str, Node | None, bool, bool]] = [("body", root, False, False)]
    nodes, cuts, links, at = [root], 0, 0, 0
    opened: dict[str, int] = {"body": 1}

    def pop() -> None:
        nonlocal cuts, links
        name, node, cut, link = stack.pop()
        opened[name] -= 1
        cuts, links = cuts - cut, links - link
        if node:
            nodes.pop()

    def close(names: set[str], within: set[str]) -> None:
        """Ends the open elements of ``names`` up to the nearest of ``within``."""
        depth = lowest = len(stack)
        while depth > 1 and stack[depth - 1][0] not in within - names:
            depth -= 1
            if stack[depth][0] in names:
                lowest = depth
        while len(stack) > lowest:
            pop()

    def run() -> Node:
        parts = nodes[-1].parts
        if not parts or parts[-1].name != TEXT:
            parts.append(Node(TEXT))
        return parts[-1]

    def text(piece: str) -> None:
        if piece and not cuts:
            run().parts.append(unescape(piece) if "&" in piece else piece)
            if links:
                run().link_chars += len("".join(piece.split()))

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if m[1]:
            if name == "p" and not opened.get("p"):
                continue
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name == "br" and not cuts:
                run().parts.append(" ")
            continue
        if name in VOID:
            if not cuts:
                if name == "hr":
                    nodes[-1].tags += 1
                    nodes[-1].parts.append(Node("hr"))
                else:
                    run().tags += 1
                    if name == "br":
                        run().parts.append(" ")
            continue
        if name in CLOSES_P | CUT | MARKED and opened.get("p"):
            close({"p"}, SCOPES)
        if name in SIBLINGS:
            close(SIBLINGS[name], SCOPES - SIBLINGS[name])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCK | CUT | MARKED and name not in ("a", "b", "i", "em", "strong", "span"):
            continue
        mark = _mark(m[3])
        block = name in BLOCK or name in MARKED
        cut = name in CUT or mark == HIDDEN or bool(mark and not block)
        if name in MARKED:
            mark = WEAK if name == "form" and mark < STRONG else STRONG
        elif mark and name in ("article", "main"):
            mark = WEAK
        node = None
        if not cuts and not cut:
            if block:
                node = Node(name, mark)
                nodes[-1].parts.append(node)
                nodes.append(node)
            else:
                run().tags += 1
                run().link_tags += name == "a"
        link = name == "a"
        stack.append((name, node, cut, link))
        opened[name] = opened.get(name, 0) + 1
        cuts, links = cuts + cut, links + link
    text(html[at:])
    _cut_marked(root)
    for node in _order(root):
        _settle(node)
    return root


def _cut_marked(root: Node) -> None:
    """Takes out the marked blocks that are not around the article."""
    nodes = _order(root)
    unlinked: dict[int, int] = {}
    framed: dict[int, bool] = {}
    for node in reversed(nodes):
        inner = node.children()
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str)) - node.link_chars
        unlinked[id(node)] = own + sum(unlinked[id(c)] for c in inner)
        framed[id(node)] = any(not c.mark and (c.name in ("article", "main", "h1") or framed[id(c)]) for c in inner)
    total = unlinked[id(root)]

    def goes(node: Node, last: bool) -> bool:
        return bool(node.mark) and not (total and 2 * unlinked[id(node)] >= total and (last or node.mark == WEAK or framed[id(node)]))

    def left(last: bool) -> int:
        rest, todo = total, [root]
        while todo:
            for child in todo.pop().children():
                if goes(child, last):
                    rest -= unlinked[id(child)]
                else:
                    todo.append(child)
        return rest

    last = left(False) <= 0
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.name == "article"
        parts: list = []
        for part in node.parts:
            if isinstance(part, Node) and part.name != TEXT and goes(part, last):
                kept = [h for h in _order(part) if h.name in ("h1", "h2")] if inside and part.name == "header" else []
                parts += kept
                todo += [(h, inside) for h in kept]
                continue
            if isinstance(part, Node) and part.name != TEXT:
                todo.append((part, inside))
            before = parts[-1] if parts else None
            if isinstance(part, Node) and part.name == TEXT and isinstance(before, Node) and before.name == TEXT:
                # The runs on both sides of what was taken out are one.
                before.parts += part.parts
                before.tags, before.link_tags, before.link_chars = before.tags + part.tags, before.link_tags + part.link_tags, before.link_chars + part.link_chars
                continue
            parts.append(part)
        node.parts = parts


def _settle(node: Node) -> None:
    """Runs without characters, and the only run of a block without child blocks, are no nodes of their own."""
    blocks, parts = any(c.name != TEXT for c in node.children()), []
    for part in node.parts:
        if not isinstance(part, Node) or part.name != TEXT or (blocks and any(x.strip() for x in part.parts)):
            parts.append(part)
            continue
        parts += part.parts
        node.tags, node.link_tags, node.link_chars = node.tags + part.tags, node.link_tags + part.link_tags, node.link_chars + part.link_chars
    node.parts = parts


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo.extend(reversed(node.children()))
    return out


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their densities and sums."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        for child in node.children():
            node.chars += child.chars
            node.link_chars += child.link_chars
            node.tags += child.tags + (child.name != TEXT)
            node.link_tags += child.link_tags
    whole = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = log(c / max(c - lc, 1) * lc + whole * c + e)
            node.density = c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / base if lc else c / t * log(max(c * t, e)) / base
        children = node.children()
        node.total = sum(x.density for x in children) or node.density
    return nodes


def _best(node: Node) -> Node:
    best = node
    for x in _order(node):
        if x.total > best.total:
            best = x
    return best


def _blocks(node: Node) -> list[str]:
    out, run = [], []
    todo: list = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            run.append(part)
            continue
        out.append("".join(run))
        run = []
        if part is None:  # the end of a block
            continue
        todo.append(None)
        todo.extend(reversed(part.parts))
    out.append("".join(run))
    return [b for b in (" ".join(x.split()) for x in out) if b]


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by line breaks."""
    if not html:
        return ""
    root = parse(html)
    measure(root)
    if not root.chars:
        return ""
    main = _best(root)
    parent = {id(c): n for n in _order(root) for c in n.children()}
    path, at = [], main
    while at is not root:
        path.append(at)
        at = parent[id(at)]
    threshold = min([n.density for n in [*path, root]])
    marked: list[Node] = []
    inside = {id(n) for n in path} | {id(root)}
    around = next((i + 1 for i, n in enumerate(path) if n.name == "article"), 0)
    article = {id(n) for n in path[:around]}
    todo = [root]
    while todo:
        node = todo.pop()
        if node is main:
            marked.append(node)
        elif id(node) in inside:
            todo.extend(reversed(node.children()))
        elif node.chars and (node.density >= threshold or (node.name == TEXT and id(parent[id(node)]) in article)):
            marked.append(_best(node))
    return "\n".join(b for n in marked for b in _blocks(n))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` plus ``_main_text`` and its code points, ``_n_chars``."""

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(x.as_py()) for x in column]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return annotate(pages, html_col, [("_main_text", "string"), ("_n_chars", "bigint")], make)
