"""Main text of web pages by composite text density.

A page becomes a tree of elements. Whatever is never article text is cut
first: scripts, styles, forms, menus, headers and footers of the page,
sidebars, notices, adverts and reader comments, by element, role and the
words of class and id. Such words may also stand on what holds the article, so
they cut nothing that holds the text of the article elements or most of the
body's text outside links. For every node that is left the composite text density
(Sun, Song and Liao, 2011) is computed from its characters C, characters in
links LC, tags T and tags in links LT: characters per tag, lessened by the
share of links at the node and of the whole body. A node's density sum is the
sum of its children's densities. The threshold is the least density on the
path from the body to the node of the largest sum. An ``article`` or ``main``
element on that path, or such elements that hold most of that node, are the
main text; without one, every node that reaches the threshold marks the
largest sum in it, and the marked subtrees are.

Blocks are the runs of text between block elements and line breaks, white
space inside as one space, joined by a newline. Tags that are left open are
closed as browsers do for the cases that change blocks: a paragraph, list
item, row, cell or option ends at the next of its kind and with its parent.

Results by case: a null or empty page, and one without article text, gives an
empty text; a page cut off in the middle ends there; plain text without tags
is one article; repeated rows are read one by one; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
_DROPPED = _RAW | frozenset("head nav aside footer form button select option input dialog menu map".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "body", "html"} | {"li", "dd", "dt"}
#: What an element closes when it begins, up to the nearest of the elements that bound it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_HOLDS_PARAGRAPH = frozenset(("td", "th", "table", "button", "object"))
#: Words of class, id and role that mark what is not article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer notice notices notification cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus replies reply respond discussion share sharing social "
    "related recommended recommendations widget complementary contentinfo search pagination pager skip toolbar alert".split()
)
#: Marks of what others say, which may well be longer than the article.
_OTHERS = frozenset(
    "comment comments disqus replies reply respond discussion ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split()
)
#: Article elements beside a marked one that holds most of the text are the article, unless they are so many times smaller.
_TEASER = 10
#: The rest of a name behind these tells what else is there, or isn't.
_BESIDES = frozenset(("has", "with", "no", "without"))
#: Marks that name the top of an article inside one, or behind these words.
_TOP, _PARTS = frozenset(("header", "masthead")), frozenset(("article", "post", "entry", "story"))
#: These hold the article though a word of their class is among the marks.
_ARTICLE = frozenset(("article", "main", "body", "html"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)(>|\Z)|([^<]++|<)",
    re.S,
)
#: One attribute: its whole name, then its value, so that the next one begins after the value.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")
_MARKING = frozenset(("class", "id", "role"))
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z][a-z]*")


class _Node:
    __slots__ = ("name", "children", "chars", "link_chars", "tags", "link_tags", "density", "total", "marks")

    def __init__(self, name: str, marks: frozenset[str] = frozenset()) -> None:
        self.name, self.marks = name, marks
        self.children: list[_Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(attributes: str, in_article: bool) -> frozenset[str] | None:
    """The marks among the attributes' words, or None of a hidden element."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return None
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return None
        for token in value.split() if name in _MARKING else ():
            before = ""
            for word in map(str.lower, _WORDS.findall(token)):
                if word in _BESIDES:
                    break
                if word in _MARKS and not (word in _TOP and (in_article or before in _PARTS)):
                    found.add(word)
                before = word
    return frozenset(found)


class _Open:
    """The open elements, innermost last. An element below a cut has no node."""

    def __init__(self, root: _Node) -> None:
        self.names, self.nodes, self.counts = [root.name], [root], Counter({root.name: 1})

    @property
    def node(self) -> _Node | None:
        return self.nodes[-1]

    def push(self, name: str, node: _Node | None) -> None:
        self.names.append(name)
        self.nodes.append(node)
        self.counts[name] += 1

    def close(self, depth: int) -> None:
        for name in self.names[depth:]:
            self.counts[name] -= 1
        del self.names[depth:], self.nodes[depth:]

    def close_named(self, names: frozenset[str] | set[str], bounds: frozenset[str] | set[str] = frozenset(), outermost: bool = False) -> None:
        """Close the innermost (or outermost) element of these names that no bound encloses."""
        if not any(self.counts[n] for n in names):
            return
        found = None
        for depth in range(len(self.names) - 1, 0, -1):
            if self.names[depth] in bounds:
                break
            if self.names[depth] in names:
                found = depth
                if not outermost:
                    break
        if found is not None:
            self.close(found)

    def make_room(self, name: str) -> None:
        """Close what ends where an element of this name begins."""
        if name in _ENDS_PARAGRAPH:
            self.close_named({"p"}, _HOLDS_PARAGRAPH)
        if name in _CLOSES:
            self.close_named(*_CLOSES[name], outermost=True)


def parse(html: str) -> _Node:
    """The tree below the body; what is never article text is not in it."""
    root = _Node("body")
    open_, at = _Open(root), 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        if m is None:  # a quote left open: the tag ends at the next sign that can end one
            named, end = _NAME.match(html, at), html.find(">", at)
            if end < 0:
                break
            closing, opening, attributes, text, at = None, named and named.group(1), "", None, end + 1
        else:
            closing, opening, attributes, finished, text = m.groups()
            at = m.end()
            if opening and not finished:
                break  # cut off inside a tag
        if text is not None:
            if open_.node:
                open_.node.children.append(text)
        elif closing:
            open_.close_named({closing.lower()})
        elif opening:
            name = opening.lower()
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = at if attributes.rstrip().endswith("/") else end.end() if end else len(html)
            elif name not in ("html", "body"):
                open_.make_room(name)
                in_article = bool(open_.counts["article"] or open_.counts["main"])
                cut = not open_.node or name in _DROPPED or name == "header" and not in_article
                marks = _marks(attributes, in_article) if attributes and not cut and name not in _ARTICLE else frozenset()
                node = None if cut or marks is None else _Node(name, marks)
                if node:
                    open_.node.children.append(node)
                if name not in _VOID:
                    open_.push(name, node)
    _cut_marked(root)
    return root


def _cut_marked(root: _Node) -> None:
    """Cut the marked elements, but for those that hold the article."""
    order = _in_order(root)
    if not any(node.marks for node, _, _ in order):
        return
    parents = {id(n): p for n, p, _ in order}
    free: dict[int, int] = {}  # characters outside links
    told: dict[int, int] = {}  # of them, in article elements at or below
    for node, parent, linked in reversed(order):
        own = 0 if linked or node.name == "a" else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        free[id(node)] = free.get(id(node), 0) + own
        told[id(node)] = free[id(node)] if node.name in ("article", "main") else told.get(id(node), 0)
        if parent is not None:
            free[id(parent)] = free.get(id(parent), 0) + free[id(node)]
            told[id(parent)] = told.get(id(parent), 0) + told[id(node)]
    # what article elements hold outside all marked elements
    safe, inside, marked = 0, set(), set()
    for node, parent, linked in order:
        if node.marks or parent is not None and id(parent) in marked:
            marked.add(id(node))
            continue
        if node.name in ("article", "main") or parent is not None and id(parent) in inside:
            inside.add(id(node))
            if not linked and node.name != "a":
                safe += sum(len(c.strip()) for c in node.children if isinstance(c, str))
    todo = [root]
    while todo:
        outermost = _topmost_marked(todo)
        together: Counter[frozenset[str]] = Counter()  # a text in several elements of one mark, none of which holds most of it
        for node in outermost:
            together[node.marks] += free[id(node)]
        todo = []
        for node in outermost:
            size = together[node.marks]
            beside = safe if node.marks & _OTHERS else safe * _TEASER > size
            if told[id(node)] > safe or 2 * size > free[id(root)] and not beside:
                todo.append(node)
            else:
                node.name = ""
        for parent in {id(p): p for n in outermost if not n.name and (p := parents[id(n)]) is not None}.values():
            parent.children = [c for c in parent.children if isinstance(c, str) or c.name]


def _topmost_marked(nodes: list[_Node]) -> list[_Node]:
    """The outermost marked elements below the nodes."""
    found, stack = [], [c for n in reversed(nodes) for c in reversed(n.children) if isinstance(c, _Node)]
    while stack:
        at = stack.pop()
        if at.marks:
            found.append(at)
        else:
            stack.extend(c for c in reversed(at.children) if isinstance(c, _Node))
    return found


def _in_order(root: _Node) -> list[tuple[_Node, _Node | None, bool]]:
    """All nodes with parent and whether they are in a link, parents first."""
    found, stack = [], [(root, None, False)]
    while stack:
        node, parent, linked = stack.pop()
        found.append((node, parent, linked))
        linked = linked or node.name == "a"
        stack.extend((c, node, linked) for c in reversed(node.children) if isinstance(c, _Node))
    return found


def main_nodes(root: _Node) -> list[_Node]:
    """The subtrees that hold the main text, in page order."""
    order = _in_order(root)
    for node, parent, linked in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        if linked or node.name == "a":
            node.link_chars += own
        if parent is not None:
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            parent.tags += node.tags + 1
            parent.link_tags += node.link_tags + (linked or node.name == "a")
    body = root.link_chars / max(1, root.chars)
    for node, parent, _ in order:
        c, lc, t, lt = node.chars, max(1, node.link_chars), max(1, node.tags), max(1, node.link_tags)
        if c:
            base = log(c / max(1, c - node.link_chars) * node.link_chars + body * c + e)
            node.density = c / t * max(0.0, log(max(1.0, c / lc * t / lt))) / max(base, 1e-9) if node.link_chars else c / t
        if parent is not None:
            parent.total += node.density
    for node, _, _ in order:
        if not any(isinstance(c, _Node) for c in node.children):
            node.total = node.density
    best = max((n for n, _, _ in order), key=lambda n: n.total)
    parents = {id(n): p for n, p, _ in order}
    path, up = [best], best
    while (up := parents[id(up)]) is not None:
        path.append(up)
    # an element that says it is the article is taken whole, if the densest text is in it
    named = [n for name in ("article", "main") for n in path if n.name == name]
    if not named and (inner := _inside(best, "article") or _inside(best, "main")) and 2 * sum(n.chars for n in inner) >= best.chars:
        return inner
    return [named[0]] if named else _marked(order, parents, min(n.density for n in path))


def _inside(node: _Node, name: str) -> list[_Node]:
    """The outermost elements of that name below a node, in page order."""
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        if at.name == name:
            found.append(at)
        else:
            stack.extend(c for c in reversed(at.children) if isinstance(c, _Node))
    return found


def _marked(order: list[tuple[_Node, _Node | None, bool]], parents: dict[int, _Node | None], threshold: float) -> list[_Node]:
    """Every node that reaches the threshold, as do all around it, marks the largest sum in it; the outermost marked nodes."""
    largest: dict[int, _Node] = {}
    for node, parent, _ in reversed(order):
        own = largest.setdefault(id(node), node)
        if node.total >= own.total:
            own = largest[id(node)] = node
        if parent is not None and own.total > largest.setdefault(id(parent), own).total:
            largest[id(parent)] = own
    reached, marked = set(), set()
    for node, parent, _ in order:
        if node.density >= threshold - 1e-9 and (parent is None or id(parent) in reached):
            reached.add(id(node))
            marked.add(id(largest[id(node)]))
    inside, outermost = set(), []
    for node, parent, _ in order:
        if parent is not None and id(parent) in inside:
            inside.add(id(node))
        elif id(node) in marked:
            inside.add(id(node))
            outermost.append(node)
    return outermost


def blocks(node: _Node) -> list[str]:
    """The blocks of text below a node, in order."""
    found, run = [], []

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        if text:
            found.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif item is None:
            close()
        else:
            block = item.name in _BLOCKS
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
    close()
    return found


def main_text(html: str) -> str:
    return "\n".join(block for node in main_nodes(parse(html)) for block in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """Per row ``page_id``, ``url`` and ``text``, the main text of ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
