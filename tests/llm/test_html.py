"""HTML extraction against a reader built on the standard library's parser, and on broken, odd and very long pages."""

import time
from html.parser import HTMLParser

import pytest

from framewright.llm import html_labelled, html_text
from framewright.llm.queries import QUERIES

SENTENCE = "A long enough sentence stands here in a plain block, as old pages have it."


class Plain(HTMLParser):
    """The blocks of all articles, by another parser and without a classifier."""

    BREAKS = {"p", "div", "h1", "h2", "h3", "ul", "ol", "li", "article", "nav", "footer", "body", "html", "table", "tr", "td", "section", "blockquote", "pre"}
    OUT = {"nav", "aside", "footer", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.inside, self.out = [], "", 0, 0

    def flush(self):
        if text := " ".join(self.held.split()):
            self.blocks.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.flush()
        self.inside += tag == "article"
        self.out += tag in self.OUT
        if tag == "br" and self.inside:
            self.held += " "

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside and not self.out:
            self.held += data


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_by_another_parser(spark, sf):
    d = f"/root/testdata/{sf}"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    out = QUERIES["op2_html_text"](spark, d).collect()
    assert len(out) == len(pages)
    for r in out:
        p = Plain()
        p.feed(pages[r.page_id] or "")
        p.flush()
        assert r.text == "\n\n".join(p.blocks) and r.n_chars == len(r.text)


def used(node):
    return {node[0]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()


def test_tree_fits_its_table_and_uses_the_neighbours():
    x, y = html_text.labelled()
    assert len(x) == len(y) > 200
    assert [html_text.is_main(html_text.tree(), r) for r in x] == [bool(v) for v in y]
    by = {html_text.FEATURES[f] for f in used(html_text.tree())}
    assert {"words before", "words after", "density before", "density after", "words", "density", "region"} <= by
    assert html_text.FEATURES[html_text.tree()[0]] != "named"


def test_tree_on_pages_left_out():
    """Grown without a page, the tree still tells most of that page's blocks."""
    right = total = 0
    for k in range(0, len(html_labelled.PAGES), 4):
        kept = html_labelled.PAGES
        try:
            html_text.PAGES = kept[:k] + kept[k + 1 :]
            node = html_text.grow(*html_text.labelled())
            html_text.PAGES = (kept[k],)
            x, y = html_text.labelled()
        finally:
            html_text.PAGES = kept
        right += sum(html_text.is_main(node, r) == bool(v) for r, v in zip(x, y))
        total += len(y)
    assert right > 0.85 * total


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><div class="a""><p>one two.</p></div><p>three</p></article>', "one two.\n\nthree"),
        ("<article><p title=it's>text here</p><p>x</p></article>", "text here\n\nx"),
        ('<article><p data-y="²">a b c</p><p data-y="' + "9" * 5000 + '">d</p></article>', "a b c\n\nd"),
        (f'<body><div class="layout with-sidebar"><p>{SENTENCE}</p></div></body>', SENTENCE),
        (f'<div class="page no-comments"><article><p>{SENTENCE}</p></article></div>', SENTENCE),
        (f'<div class="comments"><article><h1>A</h1><p>{SENTENCE}</p></article></div>', f"A\n\n{SENTENCE}"),
        (f'<article><div class="post-header"><h1>Head</h1></div><p>{SENTENCE}</p></article>', f"Head\n\n{SENTENCE}"),
        (f'<article><header><h1><a href="/x">Head</a></h1></header><p>{SENTENCE}</p></article>', f"Head\n\n{SENTENCE}"),
        ('<article><p>Words <span class="tags">cut</span> out.</p></article>', "Words cut out."),
        ("<article><p>a</p><button>Go<p>b</p></article>", "a\n\nGo\n\nb"),
        ("<article><p>a</p><button>Go</button><p>b</p></article>", "a\n\nb"),
        ("<article><title>never closed<p>a</p></article>", "never closed\n\na"),
        ("<article><script>x = '</p>'</script ><p>a</p><style>p{}</style><svg><text>t</text></svg></article>", "a"),
        ("<article><p>a<!-- <p>hidden</p> -->b</p><!--> <p>c</p> <!-- d --!><p>e</p></article>", "ab\n\nc\n\ne"),
        ("<div><article><p>a</p></div><p>b</p></article><p>c</p>", "a\n\nb"),
        ("<article><ul><li>one<li>two</ul></li><p>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<article><p>1 &lt; 2 &amp;&amp; 3 > 2, a < b</p></article>", "1 < 2 && 3 > 2, a < b"),
        ("<article><p>&#x263A;&#9786;&eacute; &nosuch; caf&eacute</p></article>", "☺☺é &nosuch; café"),
        ("<ARTICLE><P CLASS=x/>Caps</P></ARTICLE>", "Caps"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>quote never <a href='x>closed</p><p>b</p></article>", "quote never closed\n\nb"),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_parts_of_an_article_that_are_not_its_text():
    page = (
        f'<article><h1>A</h1><p>{SENTENCE}</p><aside>By the way, there is more to be said of this at another time.</aside><div class="share-buttons">Share this with your friends and family today</div>'
        f'<div class="ad">{SENTENCE}</div><form><p>Your name</p></form><nav>Next page</nav><p>No.</p><footer>Filed under notes</footer><section class="comments"><p>{SENTENCE}</p></section></article>'
    )
    assert html_text.main_text(page) == f"A\n\n{SENTENCE}\n\nNo."


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<b>" * 100_000, "<button>" * 100_000, "<title>" * 100_000, "<p" * 100_000, "<a b='" * 100_000, "<a b=\"'>" * 100_000, "<!--" * 100_000, "<" * 100_000, "<article><div></section>" * 50_000, "</article><main><div></section>" * 30_000, "&#" * 100_000],
    ids=range(13),
)
def test_time_grows_with_the_page(page):
    html_text.tree()
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_very_long_page():
    text = "\n\n".join(f"{SENTENCE} {i}" for i in range(20_000))
    page = "<article>" + "".join(f"<p>{p}</p>" for p in text.split("\n\n")) + "</article>"
    assert html_text.main_text(page) == text


def test_empty_table_nulls_and_clashing_columns(spark):
    kinds = "page_id bigint, url string, html string, text string, n_chars string"
    assert html_text.extracted(spark.createDataFrame([], kinds)).count() == 0
    rows = html_text.extracted(spark.createDataFrame([(None, None, None, "x", "y"), (1, "u", "", "x", "y"), (1, "u", "<article>a</article>", None, None), (1, "u", "<article>a</article>", None, None)], kinds)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1)], key=str)
