"""Main text of web pages by scoring the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.llm.common import mapped, slices

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|noembed|noframes|xmp|svg|math"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # what an opening tag ends, and what shields it
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
# Parts that are not the article, by element, role, and word of class or id.
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset select object".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus feedback footer form gdpr header login masthead menu menus modal nav navbar navigation "
    "navigations newsletter notice notices notification notifications overlay pager pagination popup privacy promo promos promotion "
    "recommendations recommended related replies reply respond search share sharing shares sidebar sidebars signup skip social sponsor "
    "sponsored sponsors subscribe subscription teaser toolbar widget widgets".split()
)
# Words that say nothing about a part: with an aside word they still name no article.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box buttons card cards col column container content desktop fixed form global group hidden holder icon "
    "icons inner item items left link links list mobile module outer page panel post posts right root row section site slot small "
    "sticky text thread title top unit wrap wrapper".split()
)
BONUS = {"article": 25.0, "main": 12.0, "section": 4.0, "div": 4.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}

LABEL = 60  # characters

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <[!?][^>]*(?:>|\Z)
      | <(?P<raw>%s)(?=[\s/>])(?:[^>"']+|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>"']+|"[^"]*"|'[^']*')*+)>
      | <(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>
      | </?[a-z][^>]*\Z"""
    % RAW,
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_aside(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element is no part of an article: by what it is, or only by its names; and whether a name hints at it.

    A name rules out where one of its tokens says nothing else. An aside word among others, as in
    "social-history", is a hint.
    """
    if tag in ASIDE_TAGS:
        return True, False, False
    named, hinted = False, False
    for key, value in _ATTRIBUTE.findall(rest) if rest and not rest.isspace() else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, False, False
        if key == "role" and value.lower() in ASIDE_ROLES:
            return True, False, False
        for token in value.split() if key in ("class", "id") else ():
            words = {w.lower() for w in _WORD.findall(token)}
            if words & ASIDE_WORDS:
                hinted = True
                named = named or words <= ASIDE_WORDS | NEUTRAL_WORDS
    return named, named, hinted and not named


class Page:
    """A page as lists by node (a parent comes before its children) and its texts in order."""

    def __init__(self, html: str) -> None:
        self.tag, self.up, self.aside, self.only_named, self.hinted = ["#"], [-1], [False], [False], [False]
        self.texts: list[tuple[int, str]] = []  # node -1: a block begins or ends here
        stack = [0]

        def pop_to(wanted: frozenset, shield: frozenset) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in wanted:
                    del stack[i:]
                    return
                if self.tag[stack[i]] in shield:
                    return

        at = 0
        for token in _TOKEN.finditer(html):
            if token.start() > at:
                self.texts.append((stack[-1], html[at : token.start()]))
            at = token.end()
            name = token["name"] or token["name2"]
            if not name:
                continue
            name = name.lower()
            block = name in BLOCK
            if block or name == "br":
                self.texts.append((-1, ""))
            if token["close"] or token["close2"]:
                for i in range(len(stack) - 1, 0, -1):
                    open_ = self.tag[stack[i]]
                    if open_ == name:
                        del stack[i:]
                        break
                    if not block and open_ in BLOCK:
                        break
                continue
            if name in VOID:
                continue
            if block:
                pop_to(_P, _SHIELD)
            if name in CLOSES:
                pop_to(*CLOSES[name])
            aside, named, hinted = is_aside(name, token["rest"] or token["rest2"] or "")
            self.tag.append(name)
            self.up.append(stack[-1])
            self.aside.append(aside)
            self.only_named.append(named)
            self.hinted.append(hinted)
            stack.append(len(self.tag) - 1)
        if at < len(html):
            self.texts.append((stack[-1], html[at:]))

    def settle(self) -> None:
        """A name does not rule out what holds the article or is it; children share a parent's fate.

        What a name only hints at goes if half of its text is linked, or if it has no more text than a label.
        """
        if any(self.hinted):
            n = len(self.tag)
            size, linked, link = [0] * n, [0] * n, [False] * n
            for i in range(1, n):
                link[i] = self.tag[i] == "a" or link[self.up[i]]
            for node, text in self.texts:
                if node >= 0:
                    length = len(text.strip())
                    size[node] += length
                    linked[node] += length if link[node] else 0
            for i in range(n - 1, 0, -1):
                size[self.up[i]] += size[i]
                linked[self.up[i]] += linked[i]
            for i in range(1, n):
                if self.hinted[i] and (2 * linked[i] >= size[i] or size[i] < LABEL):
                    self.aside[i] = self.only_named[i] = True
        holds = [t in ("article", "main", "body", "html") for t in self.tag]
        for i in range(len(self.tag) - 1, 0, -1):
            holds[self.up[i]] |= holds[i]
        for i in range(1, len(self.tag)):
            if self.only_named[i] and holds[i]:
                self.aside[i] = False
            self.aside[i] |= self.aside[self.up[i]]

    def scores(self) -> tuple[list[float], list[int], list[int]]:
        """Points of each node, and the lengths of its text and of its linked text."""
        n = len(self.tag)
        size, commas, linked, points = [0] * n, [0] * n, [0] * n, [0.0] * n
        link = [False] * n
        home = list(range(n))  # the block that an inline element's text belongs to
        for i in range(1, n):
            link[i] = self.tag[i] == "a" or link[self.up[i]]
            if self.tag[i] not in BLOCK:
                home[i] = home[self.up[i]]
        for node, text in self.texts:
            if node >= 0 and not self.aside[node]:
                length = len(text.strip())
                size[home[node]] += length
                commas[home[node]] += text.count(",") + text.count("\u060c") + text.count("\u3001")
                if link[node]:
                    linked[home[node]] += length
        for i in range(n):
            if size[i]:
                own = 1 + commas[i] + min(size[i] / 100, 3)
                own *= 1 - linked[i] / size[i]
                paragraph = self.tag[i] in _PARAGRAPH
                share, node = 1.0, self.up[i] if paragraph and i else i
                for _ in range(3):
                    if node < 0:
                        break
                    points[node] += own * share
                    share, node = share / 2, self.up[node]
        for i in range(n - 1, 0, -1):
            size[self.up[i]] += size[i]
            linked[self.up[i]] += linked[i]
        for i in range(n):
            if points[i]:
                points[i] = (points[i] + BONUS.get(self.tag[i], 0.0)) * (1 - linked[i] / max(size[i], 1))
        return points, size, linked


_P, _SHIELD = frozenset(["p"]), frozenset(["button", "table", "td", "th", "caption", "object"])
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt td th blockquote figcaption caption".split())


def main_text(html: str) -> str:
    """The article's text: blocks with single spaces, joined by one space; empty if there is none."""
    page = Page(html)
    page.settle()
    points, size, linked = page.scores()
    able = [i for i in range(len(points)) if points[i] > 0 and not page.aside[i]]
    if not able:
        return ""
    best = max(able, key=lambda i: (points[i], -i))
    node = best
    while node > 0:  # sections of one article belong together
        if page.tag[node] == "article":
            best = node
        node = page.up[node]
    kept = [False] * len(points)
    kept[best] = True
    for i in able:
        if page.up[i] == page.up[best] and i != best and points[i] >= max(10, 0.2 * points[best]):
            kept[i] = True
        elif page.up[i] == page.up[best] and page.tag[i] in _PARAGRAPH and size[i] >= 80 and linked[i] < 0.25 * size[i]:
            kept[i] = True
    for i in range(1, len(points)):
        kept[i] = kept[i] or kept[page.up[i]]
    parts = [" " if node < 0 else text for node, text in page.texts if node < 0 or kept[node] and not page.aside[node]]
    return " ".join(unescape("".join(parts)).split())


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html but with the main text in ``out`` and its length in ``n_chars``.

    Each block of text (a paragraph, heading, list item, cell, or loose text of a container) makes points,
    one and one more for each comma and up to three for its length, less its share of linked
    text. They go to its container, half to the one above and a quarter to the next. Containers are
    discounted by link density in turn; the best one is kept, or the article it is a part of, and
    its siblings with a fifth of its points or long unlinked paragraphs. Menus, headers,
    footers, sidebars, notices, adverts, forms and reader comments count nowhere and are left
    out inside the article too: by element, role, or a token of class or id that names nothing
    else, and where such a word is one among others if the text is mostly linked or no longer than a label. A name never
    rules out what holds the article. Scripts, styles, comments and markup go.
    Character references are decoded once, after the markup is gone.

    One row per row, all other columns as they are (``out`` and ``n_chars`` are replaced).
    NULL or empty html, or none that scores: an empty text. Broken or cut markup is read on
    as browsers do; a tag that the end cuts off is markup. Pages are read whole.
    """
    names = [c for c in pages.columns if c not in (html, out, "n_chars")]
    fields = [pages.schema[n] for n in names] + [T.StructField(out, T.StringType())]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__html"):
            texts = [main_text(h) if h else "" for h in part.column(len(names)).to_pylist()]
            yield pa.record_batch([*part.columns[: len(names)], pa.array(texts, pa.string())], [*names, out])

    done = mapped(pages.select(*names, F.col(html).alias("__html")), extract, T.StructType(fields))
    return done.withColumn("n_chars", F.length(out).cast("long"))
