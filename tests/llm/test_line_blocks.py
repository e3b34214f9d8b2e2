import html
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st

from leadrank.llm import line_blocks, queries
from leadrank.llm.line_blocks import main_text

ARTICLE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy <b>now</b></div><article><header><h1>Ti<i>t</i>le</h1></header><p>One &amp;   two&hellip;<br>three
<p>Four <a href="x">five</a></p><div class="newsletter"><form>Mail?</form></div><ul><li>six<li>seven</ul>
<section id="comments"><p>First!</p></section><footer>tags</footer></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""
PLAIN = """<body><div id="menu"><a>a</a> <a>b</a></div><div><a href=1>Other story one</a></div><div><a href=2>Other story two</a></div>
<div><h2>Heading</h2><p>{0}</p><p>short</p><p>{0}</p></div><div>x</div><div><a href=3>Terms of use</a></div><div><a>Help</a></div></body>"""


def test_the_article_stays():
    assert main_text(ARTICLE) == "Title One & two… three Four five six seven"


def test_without_a_marked_article_the_surge_is_kept():
    text = "This is a sentence of the text that goes on for quite a while."
    assert main_text(PLAIN.format(text)) == f"Heading {text} short {text}"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text", "plain text"),
        ("<p>un<b>closed <i>tags", "unclosed tags"),
        ('<div class="ad">open <article><p>yes</p></article>', "yes"),
        ("<main><p>a</p><article class=comment>no</article></main>", "a"),
        ("<article>kept too</article><article>kept and longer</article><article>n</article>", "kept too kept and longer n"),
        ('<article>a<div class="related-work">b</div><p id="notice-period">c</p><p class="share-buttons">no</p></article>', "a b c"),
        ('<article>a<div class="x ad">no</div><div class="ad-slot-2">no</div><p class="comment-list">no</p></article>', "a"),
        ("<main><p>path<article>long text of it</article><article>b</article></main>", "long text of it b"),
        ("<main><p>long text of it<article>b</article></main>", "long text of it b"),
        ("<article>1 < 2 and <!-- not --> 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<article>a<script>b</script>c<!-- open", "ac"),
        ('<article><p hidden>no</p><p style="display: none">no</p><p title="a > b">yes</p></article>', "yes"),
        ("<article>a</article><script>b", "a"),
        ("<p>a<script>b<p>c", "a"),
        ("<p>a <!-- b > c", "a"),
        ("<nav>only menu</nav>", ""),
        ("<article>&am &amp &notanentity; &#65;</article>", "&am & ¬anentity; A"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_of_text_beside_articles_what_surges_stays():
    """The breadcrumb and the line at the end stand in the same `main` as two paragraphs that are main text."""
    article = "<article><p>one line</p><p>and another</p><p>and a third</p></article>"
    text = "A paragraph of the page that stands beside its articles."
    page = f"<main><p>path</p>{article}<p>{text}</p><p>{text}</p>{article}<p>tags</p></main>"
    inside = "one line and another and a third"
    assert main_text(page) == f"{inside} {text} {text} {inside}"
    assert main_text(f"<main><h1>T</h1><p>{text}</p><p>a</p><p>b</p><p>c</p><p>end</p></main>") == f"T {text} a b c end"


def test_windows():
    import numpy as np

    keep = line_blocks.between(np.array([0, 0, 0, 50, 0, 60, 0, 0, 0, 5, 0, 0]), 40, 2)
    assert keep.nonzero()[0].tolist() == [3, 4, 5]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.lists(st.sampled_from(["<p>", "</p>", "<div", ">", "<article>", "<!--", '"', "</", "&", "<script>"]), max_size=30))
def test_any_page_is_taken(text, parts):
    assert isinstance(main_text(text.join(parts)), str)
    words = html.escape(text)
    assert main_text(f"<article><p>{words}</p></article>") == " ".join(html.unescape(words).split())


class Plain(HTMLParser):
    """Text of the articles of well-formed pages, block by block."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks = [], [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in line_blocks.VOID:
            classes = (dict(attrs).get("class") or "").split()
            self.open.append((tag, tag in line_blocks.DROPPED or tag in ("script", "style") or "ad" in classes))
        if tag not in line_blocks.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        while any(name == tag for name, _ in self.open) and self.open.pop()[0] != tag:
            pass
        if tag not in line_blocks.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if any(tag == "article" for tag, _ in self.open) and not any(dropped for _, dropped in self.open):
            self.blocks[-1] += data


def test_the_query_equals_a_plain_parser(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op10_line_blocks"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(found) == len(pages) > 0
    for page in pages:
        text = " ".join(" ".join(block.split()) for block in Plain(page.html or "").blocks if block.strip())
        assert found[page.page_id] == (text, len(text))


def test_deep_and_hostile_pages_take_linear_time():
    assert main_text("<div>" * 50_000 + "x") == "x"
    main_text('<a "' * 20_000)
    main_text("<" * 50_000)


def test_awkward_rows(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (None, "v", ""), (1, "u", ARTICLE), (4, "w", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as TEXT", "2 as extra")
    found = line_blocks.extracted(pages).collect()
    assert len(found) == 5 and found[0].n_chars == len(found[0].text) == len(main_text(ARTICLE)) and found[0].extra == 2
    assert sorted(r.n_chars for r in found) == [0, 0, found[0].n_chars, found[0].n_chars, 499_999]
    assert line_blocks.extracted(pages.limit(0)).count() == 0
