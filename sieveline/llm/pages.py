"""Main-text extraction by tree scoring.

The html becomes a tree. Each paragraph gives points for its length and commas, whole to its
parent, by half to its grandparent and so on; within an article or main they reach that element whole. A container's points are
discounted by the share of its text that stands in links. The best container is kept with those siblings that look like the same text;
of equal ones the first in the page. Parts that are never text (scripts, menus, notices, adverts, comments of readers...) are cut before;
a form is cut unless it holds more than half of the page's text, as where a page is wrapped in one.

Null and empty html gives an empty text, as does a page without any block of text. Unclosed and stray tags are
tolerated as browsers do. Nothing is dropped or cut by length, and time grows with the length. Repeated rows are each extracted.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose content is no markup, elements never part of the text, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NEVER = RAW | frozenset("nav header footer aside button select option input label fieldset dialog menu svg math canvas audio video object map head datalist".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption div section".split())
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes first, up to the nearest of its containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id names that mark parts outside the text, and those that speak for it.
OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar\d*|side-?bar|widgets?|menu\w*|nav|navbar|navigation|navi|breadcrumbs?|foot|footer|header|masthead|topbar|cookies?\w*|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|outbrain|taboola|teaser|comments?|commentlist|comment-?section|disqus|respond|reply|replies|reviews?|discussion|pagination|pager|paging|toolbar|tags?|meta|byline|skip|search|disclaimer|legal|copyright|rss)(?:[\s_-]|$)",
    re.I,
)
INSIDE = re.compile(r"article|content|entry|post|story|text|body|main|page|column|hentry", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())

TAG = re.compile(r"<(?:!--(.*?)(?:-->|--!>|\Z)|(/?)([A-Za-z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|[!?][^>]*+(?:>|\Z)|/[^A-Za-z>][^>]*+(?:>|\Z))", re.S)
#: A stray end of these does not reach beyond those.
INLINE, CELL = frozenset("p b i span a em strong".split()), ("td", "th", "table", "li")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "names", "cut", "outside", "points", "size", "linked", "whole")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.kids, self.names = tag, parent, [], ""
        self.points, self.size, self.linked = 0.0, 0, 0
        self.cut, self.outside, self.whole = tag in NEVER, tag == "form", False
        if attributes and not self.cut:
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.names = f"{a.get('class', '')} {a.get('id', '')}".strip()
            hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            self.outside = tag == "form" or bool(self.names and tag not in ("html", "body", "article", "main") and OUTSIDE.search(self.names))
            self.cut = hidden or a.get("role", "").lower() in ROLES


class Open:
    """The open elements, and where those of each tag stand among them."""

    def __init__(self, root: Node):
        self.stack, self.of = [root], {}
        self.cut_at = 0  # place of the outermost element that is cut, or 0

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, or 0."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def first_beyond(self, tags, place: int) -> int:
        """Place of the outermost open element of these tags within the one at that place, or 0."""
        return min((of[i] for t in tags if (of := self.of.get(t)) and (i := bisect_right(of, place)) < len(of)), default=0)

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.cut and not self.cut_at:
            self.cut_at = len(self.stack)
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close the element at this place and all within it."""
        while len(self.stack) > place:
            self.of[self.stack.pop().tag].pop()
        if self.cut_at >= place:
            self.cut_at = 0


def parse(html: str) -> Node:
    """Tree of nodes; kids are nodes and strings. What is cut has no kids."""
    root = Node("#root", None)
    now, pos, n = Open(root), 0, len(html)
    endless: set[str] = set()  # elements of RAW that have no end from here on
    while pos < n:
        m = TAG.search(html, pos)
        upto = m.start() if m else n
        if upto > pos and not now.cut_at:
            now.stack[-1].kids.append(html[pos:upto])
        if not m:
            break
        pos = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            place = now.last((tag,))
            if place and not (tag in INLINE and now.last(CELL) > place):
                now.close(place)
            continue
        if tag in CLOSES or tag in ENDS_P:
            these, within = CLOSES.get(tag, ({"p"}, set()))
            if tag in ENDS_P:
                these, within = these | {"p"}, within | {"td", "th", "button", "article", "div", "section", "body", "blockquote", "li"}
            if place := now.first_beyond(these, now.last(within)):
                now.close(place)
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}[\s/>]", re.I).search(html, pos)
            if end is None:
                endless.add(tag)
                pos = n if tag in ("script", "style", "textarea", "title", "xmp") else pos
            else:
                close = html.find(">", end.start())
                pos = n if close < 0 else close + 1
            continue
        node = Node(tag, now.stack[-1], m[4])
        if not now.cut_at:
            now.stack[-1].kids.append(node)
        if tag not in VOID and not (m[4].rstrip().endswith("/") and tag in ("path", "rect", "circle")):
            now.push(node)
    return root


def cut_outside(root: Node) -> None:
    """Cut parts by names that mark them outside the text, but not those that hold an article or main without such a name, nor
    those with more than half of the page's text if they hold an article, are a form, or a name speaks for them as well."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.cut:
            order.append(x)
            todo += [k for k in x.kids if isinstance(k, Node)]
    some, plain, open_cases = set(), set(), []
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.size += len(k.strip())
            elif not k.cut:
                x.size += k.size
                if k in some or k.tag in ("article", "main"):
                    some.add(x)
                if k in plain or k.tag in ("article", "main") and not OUTSIDE.search(k.names):
                    plain.add(x)
        if x.outside and x not in plain:
            if x in some or x.tag == "form" or INSIDE.search(OUTSIDE.sub(" ", x.names)):
                open_cases.append(x)
            else:
                x.cut = True
    for x in open_cases:
        x.cut = 2 * x.size <= root.size


def weigh(node: Node) -> None:
    """Fill in, from the leaves up, how much text each node holds, how much of it stands in links, and its points; no recursion, for deep trees."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        if not x.cut:
            order.append(x)
            for k in x.kids:
                if isinstance(k, Node):
                    k.whole = x.whole or x.tag in ("article", "main")
                    todo.append(k)
    for x in reversed(order):
        size = linked = own = commas = 0
        for k in x.kids:
            if isinstance(k, str):
                n = len(k.strip())
                size += n
                own += n
                commas += k.count(",")
            elif not k.cut:
                size += k.size
                linked += k.linked
                if k.tag not in BLOCK:
                    own += k.size
        x.size, x.linked = size, size if x.tag == "a" else linked
        passed = x.points if x.whole else x.points / 2
        if x.tag in PARAGRAPH and own and x.parent is not None:
            gain = (1 + commas + min(own / 100, 3.0)) * (1 - min(1.0, x.linked / max(1, x.size)))
            if x.tag in ("div", "section"):
                x.points += gain
                gain = gain if x.whole else gain / 2
            passed += gain
        if x.parent is not None:
            x.parent.points += passed


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under these nodes in page order, each with single spaces."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    for node in nodes:
        todo: list = [node]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif not x.cut:
                if x.tag == "br":
                    line.append(" ")
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(x.kids)
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    cut_outside(root)
    weigh(root)
    best, most, todo = root, 0.0, [root]
    while todo:
        x = todo.pop()
        if x.cut:
            continue
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
        points = x.points * (1 - min(1.0, x.linked / max(1, x.size)))
        if points and (x.tag in ("article", "main") or x.names and INSIDE.search(x.names)):
            points *= 1.25
        x.points = points
        if points > most:
            best, most = x, points
    if best.parent is None or most == 0:
        return "\n".join(blocks([root]))
    keep = []
    for k in best.parent.kids if best.tag not in ("article", "main", "body", "html") else [best]:
        if k is best:
            keep.append(k)
        elif isinstance(k, Node) and not k.cut and k.size:
            density = k.linked / k.size
            same = bool(best.names) and k.names == best.names
            if k.points + most * 0.2 * same >= max(1.0, most * 0.2) and density < 0.5 or k.tag in ("h1", "h2") and density < 0.3 or k.tag in ("p", "pre", "blockquote") and density < 0.25 and (k.size > 80 or any(isinstance(t, str) and re.search(r"[.!?:]\s*\Z", t) for t in k.kids)):
                keep.append(k)
    return "\n".join(blocks(keep))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
