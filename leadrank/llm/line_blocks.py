"""Main text of web pages by the distribution of line blocks.

Markup is stripped and block elements end a line. Each line has a length; lines of menus, forms, adverts and the like
count as empty, and so does link text in pages that do not mark their article. The lengths are summed over a sliding
window of lines. Where the sum surges the text starts, where it dives the text ends; the lines between are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from leadrank.llm.common import without

WINDOW = 3
# Without a marked article: a window with so much of the fullest window's text is part of a surge, and the text then
# reaches as far as windows hold this smaller share.
SURGE_SHARE = 0.3
DIVE_SHARE = 0.05
# What stands in `main` beside articles is main text if it has so much of the longest one's text, else only their frame;
# of main text parted by articles the stretches stay that surge.
FRAME_SHARE = 0.3

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
DROPPED = frozenset("head nav footer aside form select button menu dialog svg math canvas audio video object datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words in class and id that mark what is no main text.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
CLUTTER = READERS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar"
    " navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices"
    " alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations pagination pager toolbar skip widget copyright disclaimer".split()
)
# Words that say no more about an element than that it is one. In an article `share-buttons` holds no main text, but
# `related-work` may.
PLAIN_WORDS = frozenset(
    "area bar block blocks box button buttons col column container content form group inner item items left link links"
    " list main outer panel post posts right row section slot text top bottom unit wrap wrapper small large".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
CLOSED = re.compile(rf"(?:</(?:{RAW})\s*+>|-->)\Z", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.\-]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
WORDS = re.compile(r"[a-z0-9]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Lines:
    """Text of a page by line, with what the markup tells about each."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.articles: list[int] = []  # 0 outside any
        self.frames: set[int] = set()  # those of `articles` that are no `article`
        self.pieces: list[str] = []
        self.link = 0
        self.article = 0

    def add(self, raw: str, in_link: bool, article: int) -> None:
        text = html.unescape(raw)
        self.pieces.append(text)
        self.article = article
        if in_link:
            self.link += len("".join(text.split()))

    def end(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.texts.append(text)
            self.linked.append(self.link)
            self.articles.append(self.article)
        self.pieces, self.link = [], 0


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'").lower() for name, value in ATTRIBUTE.findall(rest)}


def _clutter(names: str, in_article: bool) -> bool:
    """Whether class and id name what is no main text: any word outside articles, a whole name inside one."""
    if not in_article:
        return not CLUTTER.isdisjoint(WORDS.findall(names))
    for name in names.split():
        found = {word for word in WORDS.findall(name) if not word.isdigit()}
        if found & CLUTTER and found <= CLUTTER | PLAIN_WORDS:
            return True
    return False


def _why_dropped(name: str, rest: str, in_article: bool) -> str:
    """'tag', 'readers' or 'words' if the element holds no main text, else ''."""
    if name in DROPPED or (name == "header" and not in_article):
        return "tag"
    if not rest or name in ("html", "body", "main"):
        return ""
    found = _attributes(rest)
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if not READERS.isdisjoint(WORDS.findall(names)):
        return "readers"
    if name == "article":
        return ""
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or HIDING.search(found.get("style", ""))
    return "words" if _clutter(names, in_article) or found.get("role") in ROLES or hidden else ""


class _Open(NamedTuple):
    """An open element with what holds for all that stands in it."""

    name: str
    why: str  # it is dropped itself: 'tag', 'readers' or 'words'
    reasons: frozenset[str]  # why it or an element around it is dropped
    linked: bool
    in_article: bool  # in an element named so
    article: int


class _Stack:
    def __init__(self) -> None:
        self.open: list[_Open] = [_Open("", "", frozenset(), False, False, 0)]
        self.names: Counter[str] = Counter()
        self.articles = 0
        self.frames: set[int] = set()

    @property
    def top(self) -> _Open:
        return self.open[-1]

    def push(self, name: str, why: str, marked: bool) -> None:
        around = self.top
        opens = marked and not why and not around.in_article
        self.articles += opens
        if opens and name != "article":
            self.frames.add(self.articles)
        self.names[name] += 1
        self.open.append(
            _Open(
                name,
                why,
                around.reasons | {why} if why else around.reasons,
                around.linked or name == "a",
                around.in_article or name == "article",
                self.articles if opens else around.article,
            )
        )

    def pop(self) -> _Open:
        last = self.open.pop()
        self.names[last.name] -= 1
        return last

    def close(self, name: str) -> None:
        """Ends the innermost open element of that name and all in it; does nothing if there is none."""
        while self.names[name] and self.pop().name != name:
            pass


def stripped(page: str) -> _Lines:
    """Lines of a page without markup and without what stands in dropped elements."""
    lines, stack = _Lines(), _Stack()

    def text(start: int, stop: int) -> None:
        if stop > start and not stack.top.reasons:
            lines.add(page[start:stop], stack.top.linked, stack.top.article)

    at, last, unclosed = 0, page.rfind(">") + 1, False
    for token in TOKEN.finditer(page, 0, last):
        text(at, token.start())
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            unclosed = at == last and (token["raw"] or token[0].startswith("<!--")) and not CLOSED.search(token[0])
            continue
        if name not in INLINE:
            lines.end()
        if token["end"]:
            stack.close(name)
            continue
        if name in CLOSES_P:
            stack.close("p")
        elif stack.top.name and stack.top.name in SELF_CLOSING.get(name, "").split():
            stack.pop()
        if name in ("article", "main") and stack.top.reasons == {"words"}:
            while stack.top.reasons:  # an element left open by mistake ends here
                stack.pop()
        if name in VOID or token["rest"].endswith("/") and name not in CLOSES_P and name not in INLINE:
            continue
        marked = name in ("article", "main") or 'role="main"' in token["rest"].lower()
        stack.push(name, _why_dropped(name, token["rest"], stack.top.article > 0), marked)
    # What follows the last `>` is text, unless a script or comment goes on there.
    rest = page[at:].partition("<!--")[0]
    if not unclosed:
        text(at, at + len(rest))
    lines.end()
    lines.frames = stack.frames
    return lines


def weights(lines: _Lines) -> tuple[np.ndarray, np.ndarray]:
    """Length of each line as far as it counts, and the number of its article, 0 in pages that mark none.

    All articles of a page count, short ones too; an article within `main` has a number of its own.
    """
    lengths = np.fromiter(map(len, lines.texts), np.int64, len(lines.texts))
    articles = np.array(lines.articles, np.int64)
    if articles.any():
        sizes = np.bincount(articles, weights=lengths)
        counts = sizes >= FRAME_SHARE * sizes[1:].max()
        counts[[number for number in range(len(sizes)) if number not in lines.frames]] = True
        counts[0] = False
        return np.where(counts[articles], lengths, 0), articles
    return np.maximum(0, lengths - np.array(lines.linked, np.int64) * 2), articles


def between(lengths: np.ndarray, surge: float, dive: float) -> np.ndarray:
    """Which lines lie between a surge and the next dive of the window sums.

    A window is named after its first line. A run of windows above `dive` counts if one of them reaches `surge`; its
    lines are kept from the first that is not empty on.
    """
    keep = np.zeros(len(lengths), bool)
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    above = np.concatenate(([False], sums > dive, [False]))
    edges = np.flatnonzero(above[1:] != above[:-1])
    for start, stop in zip(edges[::2], edges[1::2]):
        if sums[start:stop].max() >= surge:
            full = start + np.flatnonzero(lengths[start:stop])
            keep[full[0] : full[-1] + 1] = True
    return keep


def _peak(lengths: np.ndarray) -> int:
    """Text of the fullest window."""
    return np.convolve(lengths, np.ones(WINDOW, np.int64)).max()


def main_text(page: str | None) -> str:
    """The article of a page as one line of text, empty if there is none."""
    if not page:
        return ""
    lines = stripped(page)
    lengths, articles = weights(lines)
    if not lengths.any():
        return ""
    if not articles.any():
        peak = _peak(lengths)
        keep = between(lengths, SURGE_SHARE * peak, DIVE_SHARE * peak)
    else:
        keep = (lengths > 0) & ~np.isin(articles, list(lines.frames))
        for number in lines.frames:
            own = np.where(articles == number, lengths, 0)
            if own.any():
                keep |= between(own, SURGE_SHARE * _peak(own), 0) & (own > 0)
    return " ".join(text for text, kept in zip(lines.texts, keep) if kept)


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """`pages` without the column `source`, with `text`, the main text, and `n_chars`, its code points.

    * Character references are decoded; white space inside a block becomes one space; blocks are joined by a space.
    * Null and empty pages, and pages without main text, give an empty text. Repeated rows give equal texts. Columns
      `text` and `n_chars` of `pages` are replaced. An empty table gives an empty one. Nothing is cut.
    """

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    rest = [name for name in without(pages, ["text", "n_chars"]).columns if name != source]
    rows = pages.select(*[F.col(f"`{name}`") for name in rest], texts(F.col(source)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
