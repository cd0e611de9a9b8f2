"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes flat blocks of text, one for each stretch between block-level tags.  A block's features are its word
count and link density, those of the blocks before and after it, its depth, and what it stands in: page furniture by
element (menu, footer, form), an article or not, a container whose class or id says what it is, a heading.  A decision
tree grown by Gini impurity on the labelled table of ``html_labelled`` says which blocks are main text; labels come from
that table alone, never from a page.  An article's blocks are told by what encloses them; pages without one, linked
paragraphs, short lines and bylines are told by the neighbours.

Tags are read as HTML reads them: a quote opens a value only after ``=``, so stray quotes lose nothing.  A quote or raw
text element that never closes is read on from its tag.  Scripts, styles and other raw text never become blocks.
Character references are decoded, white space in a block becomes one space, and main blocks are joined by a blank line;
nothing else is dropped, and no length is capped.  Reading takes time in proportion to the page, however long it is
and however deep or broken its nesting.

Nulls and ties: a null or empty html gives an empty text; repeated rows and null ids give a row each; an empty table
gives an empty table.  Columns beside page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.html_labelled import PAGES

# Names of HTML elements by their part in a page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
SKIPPED = {"noscript", "template", "svg", "math", "canvas", "object", "select", "option", "datalist", "button", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
SECTIONS = FURNITURE | {"article", "main", "section", "table", "td", "th", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag of these does not close the section that it stands in.
WITHIN = {"p", "li", "dt", "dd", *HEADINGS}
#: A start tag of these ends one of its kind that is still open.
ENDS_OWN = {"p", "li", "dt", "dd", "tr", "td", "th"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: What a class or id calls parts of a page that are not its article, and words that turn such a name around.
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toc", "toolbar", "widget"}
TURNED = {"no", "not", "with", "without", "has", "is", "hide", "hidden", "layout", "page", "body", "wrapper"}

TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?=[^a-zA-Z])[^>]*+(?:>|\Z)|"""
    r"""(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++))?+)*+)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:[\s/]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]++)))?+)""", re.S)
NONE: frozenset[str] = frozenset()
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Where a block stands: in furniture by its element; beside the page's article; in a page without one; in the article.
IN_FURNITURE, BESIDE, NO_ARTICLE, IN_ARTICLE = 0, 1, 2, 3


class Block:
    """A flat stretch of text, where it starts in the page, and what it stands in."""

    __slots__ = ("at", "depth", "element", "heading", "linked", "named", "region", "text", "words")

    def __init__(self, text: str, words: int, linked: int, element: int, depth: int, at: int):
        self.text, self.words, self.linked, self.element, self.depth, self.at = text, words, linked, element, depth, at
        self.region, self.named, self.heading = NO_ARTICLE, False, False


def attributes_of(s: str) -> dict[str, str]:
    """A tag's attributes, the first of equal names."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(s):
        if name:
            found.setdefault(name.lower(), a or b or c)
    return found


def names_part(value: str) -> frozenset[str]:
    """The words of NAMES that the tokens of a class or id start or end with, but not of turned ones (no-comments)."""
    out: frozenset[str] = NONE
    for token in value.split():
        own = [w.lower() for w in NAME_WORDS.findall(token)]
        if own and not TURNED & set(own):
            out |= NAMES.intersection((own[0], own[-1]))
    return out


class Reader:
    """One pass over a page: its elements in page order, and its text blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        # Of each element: parent, tag, role, names, and whether its own end tag closed it.
        self.parent, self.tags, self.roles, self.names, self.closed = [-1], [""], [""], [NONE], [True]
        self.stack: list[int] = [0]
        self.open_at: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.articles: list[int] = []
        self.held: list[str] = []
        self.start = 0
        self.linked = 0
        self.links = False

    def text(self, s: str, at: int) -> None:
        if s:
            if not self.held:
                self.start = at
            self.held.append(s)
            if self.links:
                self.linked += len(html.unescape(s).split())

    def flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            if text:
                n = text.count(" ") + 1
                self.blocks.append(Block(text, n, min(self.linked, n), self.stack[-1], len(self.stack), self.start))
        self.held, self.linked = [], 0

    def _pop_to(self, place: int) -> None:
        stack, sections, articles = self.stack, self.sections, self.articles
        while len(stack) > place:
            self.open_at[self.tags[stack.pop()]].pop()
        while sections and sections[-1] >= place:
            sections.pop()
        while articles and articles[-1] >= place:
            articles.pop()

    def open(self, tag: str, attributes: str, at: int) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = True
            elif tag == "br":
                self.text(" ", at)
            return  # what an inline element is called never parts a sentence
        self.flush()
        self.links = False
        if tag in ENDS_OWN and self.tags[self.stack[-1]] == tag or self.tags[self.stack[-1]] == "p":
            self._pop_to(len(self.stack) - 1)
        if tag in VOID or (tag in SKIPPED and attributes.endswith("/")):
            return
        self.parent.append(self.stack[-1])
        self.tags.append(tag)
        found = attributes_of(attributes) if attributes else None
        self.roles.append(found.get("role", "").strip().lower() if found else "")
        self.names.append(names_part(found.get("class", "")) | names_part(found.get("id", "")) if found else NONE)
        self.closed.append(False)
        self.open_at.setdefault(tag, []).append(len(self.stack))
        if tag in SECTIONS:
            self.sections.append(len(self.stack))
            if tag in ("article", "main"):
                self.articles.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = False
            return
        self.flush()
        self.links = False
        at = self.open_at.get(tag)
        # A stray end tag closes nothing; one of a paragraph or a list's line only within its section.
        if at and not (tag in WITHIN and self.sections and at[-1] < self.sections[-1]):
            place = at[-1]
            # A stray end of a plain container must not end the article that it stands in.
            if tag in ("article", "main", "body", "html") or not self.articles or self.articles[-1] <= place:
                self.closed[self.stack[place]] = True
                self._pop_to(place)


def read(page: str) -> Reader:
    r, at, n = Reader(), 0, len(page)
    unclosed: set[str] = set()
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            r.text(page[at:], at)
            break
        r.text(page[at : m.start()], at)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            r.close(tag)
        elif tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if end is None and tag not in ("script", "style"):
                unclosed.add(tag)  # never closed: read on rather than lose the page
                continue
            r.flush()
            at = end.end() if end else n
        else:
            r.open(tag, m[3], m.start())
    r.flush()
    return r


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order, without those of buttons, drawings and the like."""
    r = read(page)
    n = len(r.tags)
    # What elements hold, from the inside out: an element comes after its parent.
    holds_article, holds_headline = [False] * n, [False] * n
    words = [0] * n
    for b in r.blocks:
        words[b.element] += b.words - b.linked
    is_main = [r.tags[e] == "main" or r.roles[e] == "main" for e in range(n)]
    is_article = [r.tags[e] == "article" or r.roles[e] == "article" for e in range(n)]
    for e in range(n - 1, 0, -1):
        up = r.parent[e]
        words[up] += words[e]
        if holds_article[e] or is_article[e]:
            holds_article[up] = True
        if holds_headline[e] or r.tags[e] == "h1" or is_main[e] or is_article[e]:
            holds_headline[up] = True
    # What elements stand in, from the outside in.
    skipped, furniture, named, inside, beside = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
    some = False
    for e in range(1, n):
        up, tag = r.parent[e], r.tags[e]
        skipped[e] = skipped[up] or (tag in SKIPPED and r.closed[e])
        # The header of an article is part of it, unlike that of a page.
        own = (tag in FURNITURE or r.roles[e] in ROLES) and not (inside[up] and (tag == "header" or r.roles[e] == "banner"))
        # A form or a dialog around the whole article, as some page builders have it, is no furniture.
        furniture[e] = furniture[up] or (own and not holds_article[e])
        own_names = r.names[e] - {"header", "banner", "masthead"} if inside[up] else r.names[e]
        # A container's name tells nothing where it holds the article, the headline or nearly all of the page.
        named[e] = named[up] or (bool(own_names) and tag not in ("body", "html", "main") and not (holds_headline[e] or words[e] * 5 > words[0] * 4))
        inside[e] = inside[up] or ((is_article[e] or (is_main[e] and not holds_article[e])) and not furniture[e] and not named[e])
        beside[e] = beside[up] or (is_main[e] and holds_article[e])
        some = some or inside[e]
    out = []
    for b in r.blocks:
        e = b.element
        if skipped[e]:
            continue
        b.named, b.heading = named[e], r.tags[e] in HEADINGS
        b.region = IN_FURNITURE if furniture[e] else IN_ARTICLE if inside[e] else NO_ARTICLE if beside[e] or not some else BESIDE
        out.append(b)
    return out


#: Names of the features, in order.
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "depth", "region", "named", "heading")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row a block; beyond the page's ends stands a block of no words."""
    own = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in found), (0.0, 0.0)]
    return [(*own[i + 1], *own[i], *own[i + 2], float(b.depth), float(b.region), float(b.named), float(b.heading)) for i, b in enumerate(found)]


# ---- the tree

DEPTH = 10


def impurity(ones: float, n: float) -> float:
    return ones * (1 - ones / n) if n else 0.0


def grow(x: list[tuple[float, ...]], y: list[int], depth: int = DEPTH):
    """A tree as nested tuples (feature, threshold, below, above); a leaf is the share of main blocks."""
    share = sum(y) / len(y) if y else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(x[0])):
        order = sorted(range(len(x)), key=lambda i: x[i][f])
        ones, total = 0, sum(y)
        for k in range(1, len(order)):
            ones += y[order[k - 1]]
            a, b = x[order[k - 1]][f], x[order[k]][f]
            if a == b:
                continue
            gini = impurity(ones, k) + impurity(total - ones, len(order) - k)
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, (a + b) / 2)
    if best is None:
        return share
    _, f, cut = best
    sides = [[i for i in range(len(x)) if (x[i][f] <= cut) == below] for below in (True, False)]
    return f, cut, *(grow([x[i] for i in s], [y[i] for i in s], depth - 1) for s in sides)


def labelled() -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and labels of the labelled table's blocks: a block has the label of the piece that it starts in."""
    x: list[tuple[float, ...]] = []
    y: list[int] = []
    for pieces in PAGES:
        ends, at = [], 0
        for _, markup in pieces:
            at += len(markup)
            ends.append(at)
        found = blocks("".join(markup for _, markup in pieces))
        x += features(found)
        y += [pieces[next(i for i, end in enumerate(ends) if b.at < end)][0] for b in found]
    return x, y


@cache
def tree():
    return grow(*labelled())


def is_main(node, row: tuple[float, ...]) -> bool:
    while isinstance(node, tuple):
        f, cut, below, above = node
        node = below if row[f] <= cut else above
    return node > 0.5


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by a blank line."""
    found = blocks(page or "")
    own = tree()
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(own, row))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row a page, in one scan without a shuffle."""
    return pages.selectExpr("cast(page_id AS bigint) AS page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
