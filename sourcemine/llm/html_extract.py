"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks at block tags, in time linear in its length however broken its markup is.  A linear classifier over a block's
place, markup and words gives the cost of calling it content or boilerplate;
the two costs are the capacities from and to the terminals.  Neighbours in page
order and neighbours in one container (paragraphs of a section, items of a list) are
tied by smoothness edges, and the maximum flow from content to boilerplate splits the blocks at least total cost.

Scripts, styles, text areas, the head, comments and other markup never become
blocks; a tag or comment without an end never takes the rest of the page with it, but for
scripts, styles and text areas.  Character
references are decoded, white space inside a block becomes one blank, blocks
are joined in page order by one blank.  Null and empty pages, and pages without
content, give an empty text.  Repeated rows are kept; nothing is cut off.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPECIAL = re.compile("['\">]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

#: Elements whose inside is no markup and no text of the page; a head ends at its end or where the body begins.
RAW = {"script", "style", "textarea"}
#: Elements that a page shows nothing of; one without an end of its own is read as any other element.
INERT = {"iframe", "template"}
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.IGNORECASE)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html"}
#: Elements that are boilerplate wherever they stand, and those that are only outside an article.
BOILER, OUTER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}, {"header"}
#: Controls stand inside a line: they make blocks of their own.
CONTROL, IN_CONTROL = ("button", "select"), {"option", "br", "hr"}
MAIN = {"article", "main"}
#: Elements that hold one text; their container is the element around them.
TEXTUAL = {
    "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption",
    "caption", "summary", "legend", "option", "address",
}
BOILER_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
    "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Inside article or main such words count on these elements only, and not in an id:
#: ids there are often made from headings.
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table"}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story"}
SMOOTH_NEXT, SMOOTH_PARENT, UNIT = 60, 40, 100


@dataclass
class Block:
    text: str
    parent: int  # number of the container: of an element of text, what holds it
    boiler: int  # elements around it that mark boilerplate
    main: int
    heading: bool
    linked: int  # characters inside links
    doubts: int = 0  # elements around it inside article or main whose words alone mark boilerplate


def _marks(name: str, attributes: str, inside_main: bool, inside_article: bool) -> tuple[int, int, int]:
    """Whether an element marks boilerplate, main text, and doubtful text."""
    words: set[str] = set()
    telling: set[str] = set()
    for kind, value in _LABEL.findall(attributes) if "=" in attributes else ():
        some = re.split(r"[^a-z]+", value.lower())
        words.update(some)
        if not inside_article or (kind.lower() != "id" and name in CONTAINERS):
            telling.update(some)
    told = bool(telling & BOILER_WORDS)
    boiler = name in BOILER or (name in OUTER and not inside_main)
    doubt = told and inside_article and not boiler
    boiler = boiler or (told and not inside_article)
    if name in ("body", "html", *MAIN):
        boiler = doubt = False  # such words on the page itself say nothing about its parts
    main = name in MAIN or (not boiler and not doubt and bool(words & MAIN_WORDS))
    return int(boiler), int(main), int(doubt)


class Tags:
    """The markup of a page, one piece after the other: ``(start, end, closing, name,
    attributes)``; the name is empty for comments and declarations.

    A tag ends at the first ``>`` outside quotes, and ``<`` is text where there is none.
    Where each quote and ``>`` leads to is worked out once, from the end backwards, so
    no part of a page is searched again for every ``<`` before it.
    """

    def __init__(self, page: str):
        self.page = page
        self.places = [found.start() for found in _SPECIAL.finditer(page)]
        n = len(self.places)
        self.ends = [-1] * (n + 1)  # of a tag that meets this special character first
        after = {"'": n, '"': n}  # the next such quote
        for i in range(n - 1, -1, -1):
            kind = page[self.places[i]]
            if kind == ">":
                self.ends[i] = self.places[i]
            else:
                other = after[kind]
                self.ends[i] = self.ends[other + 1] if other < n else -1
                after[kind] = i
        self.missing: set[str] = set()  # what no later part of the page holds

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def search(self, pattern: re.Pattern, at: int) -> re.Match | None:
        if pattern.pattern in self.missing:
            return None
        found = pattern.search(self.page, at)
        if found is None:
            self.missing.add(pattern.pattern)
        return found

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith(("<!", "<?"), start):
                for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if page.startswith(opening, start):
                        end = self.find(closing, start + len(opening))
                        if end >= 0:
                            return start, end + len(closing), "", "", ""
            elif tag := _NAME.match(page, start):
                end = self.ends[bisect_left(self.places, tag.end())]
                if end >= 0:
                    return start, end + 1, tag[1], tag[2], page[tag.end() : end]
        return None


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    # name, container of the texts in it, boiler, main, doubts, inside article or main
    stack: list[tuple[str, int, int, int, int, bool]] = [("", 0, 0, 0, 0, False)]
    open_: Counter = Counter()
    parts: list[str] = []
    linked = number = at = 0
    heading = False
    tags = Tags(page)

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, parent, boiler, main, doubts, _ = stack[-1]
            out.append(Block(text, parent, boiler, main, heading, min(linked, len(text)), doubts))
        parts.clear()
        linked, heading = 0, False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())

    def close(name: str) -> None:
        if open_[name]:
            while True:
                gone = stack.pop()[0]
                open_[gone] -= 1
                if gone == name:
                    return

    while tag := tags.next(at):
        start, end, closing, name, attributes = tag
        add(page[at:start])
        at, name = end, name.lower()
        if not name:
            continue
        if name == "head" and not closing:
            over = tags.search(_HEAD_END, at)
            if over:
                at = over.end() if over[0][1] == "/" else over.start()
            continue  # without either, what follows is read as any other part
        if name in RAW and not closing and not attributes.rstrip().endswith("/"):
            over = tags.search(re.compile(rf"</{name}\s*>", re.IGNORECASE), at)
            at = over.end() if over else len(page)
            continue
        if name in INERT and not closing:
            over = tags.search(re.compile(rf"<(/?){name}\b[^>]*>", re.IGNORECASE), at)
            if over and over[1]:
                at = over.end()
                continue
        if name in BLOCK or name in CONTROL:
            flush()
        if name in BLOCK and name not in IN_CONTROL:
            # A control that was never closed ends where the next block begins or ends.
            for control in CONTROL:
                close(control)
        if closing:
            close(name)
        elif name not in VOID:
            if name in CLOSES_P and open_["p"] and any(x[0] == "p" for x in stack[-8:]):
                close("p")
            if name == "li" and stack[-1][0] == "li":
                close("li")
            number += 1
            _, parent, boiler, main, doubts, inside = stack[-1]
            if name in BLOCK and name not in TEXTUAL:
                parent = number
            more = _marks(name, attributes, main > 0, inside)
            stack.append(
                (name, parent, boiler + more[0], main + more[1], doubts + more[2], inside or name in MAIN)
            )
            open_[name] += 1
        heading = heading or (not closing and name in ("h1", "h2", "h3"))
    rest = page[at:]
    cut = rest.find("<")  # markup that never ends is no text
    if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]):
        rest = rest[:cut]
    add(rest)
    flush()
    return out


def costs(block: Block) -> tuple[int, int]:
    """Cost of calling a block boilerplate, and of calling it content."""
    share = block.linked / len(block.text)
    words = block.text.count(" ") + 1
    score = -1.0 + 1.2 * min(words, 40) / 20 + 0.8 * (words >= 5 and block.text[-1] in ".!?:;\"'")
    score += 0.8 * block.heading - 3.0 * share
    score += 6.0 * (block.main > 0) - (9.0 if block.boiler else 6.5 * (block.doubts > 0))
    return (round(UNIT * score), 0) if score > 0 else (0, round(-UNIT * score))


def content_side(keep: list[int], drop: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the content terminal: maximum flow
    by shortest augmenting levels, without recursion."""
    n = len(keep)
    source, sink = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, there: int, back: int) -> None:
        near[a].append(len(to))
        to.append(b)
        room.append(there)
        near[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        if keep[i]:
            tie(source, i, keep[i], 0)
        if drop[i]:
            tie(i, sink, drop[i], 0)
    for a, b, size in edges:
        tie(a, b, size, size)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[a] < len(near[a]):
                e = near[a][following[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(near[a]):
                path.append(near[a][following[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break


def label(found: list[Block]) -> list[bool]:
    """True for the blocks of the main text."""
    unary = [costs(b) for b in found]
    marked = [(b.boiler > 0, b.doubts > 0) for b in found]
    edges, last_under = [], {}
    for i, b in enumerate(found):
        if i and marked[i - 1] == marked[i]:
            edges.append((i - 1, i, SMOOTH_NEXT))
        before = last_under.get(b.parent)
        if before is not None:
            edges.append((before, i, SMOOTH_PARENT))
        last_under[b.parent] = i
    return content_side([k for k, _ in unary], [d for _, d in unary], edges)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, on in zip(found, label(found)) if on)


def extracted(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars``; only the html goes to Python."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    return pages.withColumn("text", text("html")).withColumn("n_chars", F.length("text").cast("long"))
