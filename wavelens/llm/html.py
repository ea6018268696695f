"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events; block elements cut its text into lines, each with the number of tags
it carried. The ratio of text to tags is smoothed with a Gaussian over neighbouring lines, and lines above one standard
deviation form the content cluster. The deepest container that holds nearly all of the cluster's text is the content
region, widened to the article or main element around it. Its lines are returned in page order, short ones too.

Menus, headers, footers, asides, forms, scripts and the like never count, nor do blocks headed or named as reader comments. Other
names (class, id) are evidence to be weighed with the cluster: a block whose name is all boilerplate (``ad``, ``cookie-notice``) goes
unless it holds nearly all of the cluster, and so is the page's wrapper; one whose name only contains such a word (``market-share``) goes
only if most of its text lies outside the cluster. Names that speak of another block (``has-sidebar``) say nothing.

Null html is an empty page; a page cut off anywhere is read as far as it goes. Pages are independent, so repeated rows and
any skew have no effect, and other columns are carried along. Texts are whole: nothing is capped, and the time is in proportion to the
page, however deep it is nested. Ties between lines of one ratio fall on one side of the threshold alike.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: Elements and names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer form head iframe map menu nav noframes noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that add nothing to a name beside them, and words that make it speak of another block.
NEUTRAL = frozenset("area bar block blocks bottom box button buttons col column container elem element form global group header icon icons id inner item items left line link links list main menu page panel post posts primary right secondary section site slot text title top unit wrap wrapper".split())
MODIFIERS = frozenset("has have hide no non not show with without".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_COMMENT_HEADING = re.compile(r"\W*(?:\d+\W+)?(?:reader )?(?:comments?|replies|responses|kommentare|comentarios|commentaires)\b.{0,20}$", re.I)
#: What a block's name says: nothing, a boilerplate word among others, boilerplate only, never content.
NONE, WEAK, STRONG, NEVER_CONTENT = range(4)


def named(attrs) -> int:
    """What an element's attributes say of it."""
    said = NONE
    for name, value in attrs:
        if name == "hidden":
            return NEVER_CONTENT
        if not value:
            continue
        value = value.lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = _PART.findall(token)
                if NAMES.isdisjoint(parts) or not MODIFIERS.isdisjoint(parts):
                    continue
                if all(p in NAMES or p in NEUTRAL for p in parts):
                    said = max(said, STRONG if COMMENTS.isdisjoint(parts) else NEVER_CONTENT)
                else:
                    said = max(said, WEAK)
        elif name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return NEVER_CONTENT
    return said


class _Lines(HTMLParser):
    """Collects the lines (text, tags seen, node) and the tree of the elements that matter: parents, tags and what their names say."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kinds, self.said = [-1], [""], [NONE]
        self.stack: list[int] = [0]
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, int]] = []
        self.words: list[str] = []
        self.tags = 0
        self.heading = False
        self.shut = 0  # open elements that are never content

    def cut(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1]))
            self.tags = 0
            if self.heading and len(text) < 60 and _COMMENT_HEADING.match(text) and self.kinds[self.stack[-1]] in ("div", "section"):
                self.said[self.stack[-1]] = max(self.said[self.stack[-1]], STRONG)
        self.words = []

    def close_top(self):
        n = self.stack.pop()
        self.open[self.kinds[n]] -= 1
        self.shut -= self.said[n] == NEVER_CONTENT

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        elif tag == "br":
            self.words.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        content = self.open.get("article", 0) + self.open.get("main", 0)
        if tag in ("article", "main") and self.shut and not content:
            while len(self.stack) > 1 and self.shut:  # an element that was never closed does not hide the article
                self.close_top()
        said = NEVER_CONTENT if tag in NEVER or (tag == "header" and not content) else NONE
        if not said and attrs and tag not in ("html", "body", "article", "main"):
            said = named(attrs)
        if said or tag in CONTAINERS or attrs and tag in ("header", "span", "ul", "ol", "p", "table"):
            if said:
                self.cut()
            self.stack.append(len(self.kinds))
            self.parent.append(self.stack[-2]), self.kinds.append(tag), self.said.append(said)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.shut += said == NEVER_CONTENT

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
            self.heading = False
        self.tags += 1
        if self.open.get(tag):
            while True:
                n = self.stack[-1]
                if self.said[n]:
                    self.cut()
                self.close_top()
                if self.kinds[n] == tag:
                    break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.kinds[self.stack[-1]] not in ("script", "style"):
            self.words.append(data)


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the ends count as if they went on."""
    r = math.ceil(3 * sigma)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r, "edge"), k / k.sum(), "valid")


def cluster(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Which lines have a smoothed ratio of text to tags above the threshold; all, if none has."""
    size = np.array([len(t) for t, _, _ in lines], float)
    ratio = smooth(size / np.maximum(1, [n for _, n, _ in lines]))
    chosen = ratio > min(ratio.std(), ratio.mean())
    return chosen if chosen.any() else np.ones(len(lines), bool)


def _weights(parent: list[int], lines: list[tuple[str, int, int]], take) -> list[float]:
    """Length of the taken lines' text within every node."""
    w = [0.0] * len(parent)
    for (text, _, node), own in zip(lines, take):
        if own:
            w[node] += len(text)
    for n in range(len(parent) - 1, 0, -1):  # children come after their parents
        w[parent[n]] += w[n]
    return w


def extract(html: str, share: float = 0.8, whole: float = 0.9) -> str:
    """The main text of one page."""
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[cut:]) or html.endswith("<"):
        html = html[:cut]  # the page ends within a tag
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    parent, kinds, said = parser.parent, parser.kinds, parser.said

    def below(drop: list[bool]) -> list[bool]:
        for n in range(1, len(parent)):
            drop[n] = drop[n] or drop[parent[n]]
        return drop

    gone = below([s == NEVER_CONTENT for s in said])
    lines = [x for x in parser.lines if not gone[x[2]]]
    if not lines:
        return ""
    if any(s in (WEAK, STRONG) for s in said):
        chosen = cluster(lines)
        dense, text = _weights(parent, lines, chosen), _weights(parent, lines, [True] * len(lines))
        total = max(dense[0], 1.0)
        gone = below([dense[n] < whole * total and (s == STRONG or s == WEAK and dense[n] < 0.5 * text[n]) if s else False for n, s in enumerate(said)])
        lines = [x for x in lines if not gone[x[2]]]
        if not lines:
            return ""
    weight = _weights(parent, lines, cluster(lines))
    region = max((n for n, w in enumerate(weight) if kinds[n] in CONTAINERS and w >= share * weight[0]), default=0)
    n = region
    while n:  # the outermost article or main element around it
        if kinds[n] in ("article", "main"):
            region = n
        n = parent[n]
    inside = below([n == region for n in range(len(parent))])
    return "\n".join(t for t, _, node in lines if inside[node])


def main_text(df: DataFrame, html: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The frame without its html column, with the main text and its number of code points (columns of these names are replaced)."""
    keep = [f for f in df.schema.fields if f.name not in (html, text, chars)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField(chars, T.LongType())])

    def run(batches):
        for batch in batches:
            for part, pages in text_slices(batch, html):
                got = [extract(p.decode("utf-8", "replace")) for p in pages]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], schema.names)

    return df.mapInArrow(run, schema)
