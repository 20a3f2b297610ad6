"""Main text of HTML pages from parser events and text-to-tag ratios.

The standard library's parser streams events. Text between block boundaries is a
line; a line carries its characters, those inside links, and the number of tags seen
since the line before. The ratio of characters to tags is smoothed over the page's
lines by a Gaussian, and a threshold found by two-means clustering of the smoothed
log ratios parts dense from sparse lines.

Dense lines select the content: from the page downwards, the element that holds next
to all dense characters of the element around it is entered, unless a heading would be
left outside; an article is entered whole. Inside what is selected, lines are kept, short
ones too, but for sparse lines that are mostly links (menus). Elements that HTML itself
names as navigation, footers, asides and the like give no lines. Forms, and elements whose
class, id or role names adverts, notices and the like, give none as a rule; but ratios
outvote names: an element that holds an article, or most of the page's dense characters and
no article beside it, is content whatever it is called, and a name that says other things
too (related-work, share-price) is believed only of an element whose characters are mostly
sparse. Comments go in any case.

Nulls: a null page is empty; a page without content has an empty text. Markup that never
ends, stray end tags, unclosed elements and unknown declarations are handled as a
browser's parser would skip them. Repeated rows are extracted each; an empty table gives an
empty result; extra columns are ignored; a long page takes time in proportion to its
length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that content can be confined to.
CONTAINERS = frozenset("article body div main section table td".split())
SKIPPED = frozenset("head script style noscript template iframe svg math object canvas video audio select option button textarea label input nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that name boilerplate; those of TALK name readers' comments.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs contentinfo cookie cookies consent copyright"
    " disclaimer footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification overlay pager pagination popup promo promoted recommended related share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription toolbar widget".split()
)
TALK = frozenset("comment comments commentlist disqus replies respond".split())
#: Words beside which those say what the element is not, or which part of the content it is.
NOT = frozenset("has is no not with without hide show".split())
PART = frozenset("article body content entry main page post story".split())
#: Words beside which a name of boilerplate says nothing else.
PLACES = frozenset("area bar block bottom box btn button buttons center container content group holder icons inner item items left link links list main message nav outer panel right row section site slot text top unit wrap wrapper".split())
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
#: Share of the dense characters around it that an element holds to be entered, and share
#: of a line's characters in links that makes it a menu's.
ENTER, LINKED = 0.9, 0.5
#: Share of the page's dense characters that outvotes a name, and of an element's own that makes it dense.
MOST = 0.5
#: Dense characters that an element needs to outvote its name.
LEAST = 100


def named(attrs: list[tuple[str, str | None]]) -> str:
    """What an element's names say: "talk", "aside", "perhaps" (among other things) or nothing."""
    found = ""
    for key, value in attrs:
        if key not in ("class", "id", "role") or not value:
            continue
        for token in value.lower().split():
            words = set(SPLIT.split(token)) - {""}
            if words & NOT:
                continue
            if words & TALK:
                return "talk"
            if words & NAMES and not words & PART:
                plain = all(w in NAMES or w in PLACES or w.isdigit() for w in words)
                found = "aside" if plain or found == "aside" else "perhaps"
    return found


class Lines(HTMLParser):
    """Collects lines: (text, tags, characters in links, container, whether a heading, name, whether in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.link = 0
        #: of each container: the one around it, its tag; of each named element: what the name says, whether it holds an article, the one around it
        self.around, self.kind = [0], [""]
        self.names: list[list] = []
        #: open elements: tag, whether it hides its content, container, whether in an article, name
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, -1)]
        self.count: Counter[str] = Counter()

    # a page is fed whole, so what hasn't ended by its end never does: it reaches to the end

    def parse_starttag(self, i):
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._to_end(super().parse_endtag(i))

    def parse_comment(self, i, report=True):
        return self._to_end(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self._to_end(super().parse_pi(i))

    def parse_html_declaration(self, i):
        try:
            return self._to_end(super().parse_html_declaration(i))
        except AssertionError:  # a marked section of unknown kind
            return self._to_end(self.parse_bogus_comment(i))

    def _to_end(self, k):
        return len(self.rawdata) if k < 0 else k

    def flush(self):
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                tag, _, container, article, name = self.open[-1]
                heading = any(t in HEADINGS for t, *_ in self.open[-3:])
                self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), container, heading, name, article))
                self.tags = 0
            self.parts = []
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        _, hidden, container, article, name = self.open[-1]
        if tag in BLOCKS and not hidden:
            self.flush()
        if not hidden:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
        if tag in VOID:
            return
        if not hidden:
            hidden = tag in SKIPPED or tag == "header" and not article or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            says = "" if tag in ("html", "body", "main") else named(attrs) or "aside" * (tag == "form")
            if tag in ("article", "main") and not says:
                k = name
                while k >= 0:
                    self.names[k][1] = True
                    k = self.names[k][2]
            if says:
                self.names.append([says, False, name])
                name = len(self.names) - 1
        if tag in CONTAINERS:
            self.around.append(container)
            self.kind.append(tag)
            container = len(self.around) - 1
        if tag == "a" and not hidden:
            self.link += 1
        self.open.append((tag, hidden, container, article or tag in ("article", "main"), name))
        self.count[tag] += 1

    def handle_endtag(self, tag):
        hidden = self.open[-1][1]
        if not hidden:
            self.tags += 1
        if not self.count[tag]:
            if tag == "p" and not hidden:
                self.flush()
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS and not hidden:
                    self.flush()
                for t, shut, *_ in self.open[k:]:
                    self.count[t] -= 1
                    if t == "a" and not shut and self.link:
                        self.link -= 1
                del self.open[k:]
                break
            if self.open[k][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.open[-1][1]:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means over neighbours, renormalised at the ends."""
    r = min(int(3 * sigma + 0.5), max(x.size - 1, 0))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k, "same")[: x.size] / np.convolve(np.ones(x.size), k, "same")[: x.size] if x.size > 2 * r else np.array([np.dot(x, g := np.exp(-0.5 * ((np.arange(x.size) - i) / sigma) ** 2)) / g.sum() for i in range(x.size)])


def threshold(x: np.ndarray) -> float:
    """Between the centres of two clusters of x (two-means from its extremes)."""
    a, b = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (a + b) / 2
        lo, hi = x[x <= cut], x[x > cut]
        if not lo.size or not hi.size:
            break
        na, nb = float(lo.mean()), float(hi.mean())
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    return (a + b) / 2


def selected(lines: list[tuple], around: list[int], kind: list[str], dense: np.ndarray) -> int:
    """The container that holds the content: entered from the page on as long as one inner
    element has ENTER of the dense characters and no heading is left outside."""
    n = len(around)
    weight, titles, inner = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
    for (text, _, _, c, heading, *_), d in zip(lines, dense):
        weight[c] += len(text) * bool(d)
        titles[c] += heading
    for c in range(n - 1, 0, -1):  # inner ones have larger numbers
        weight[around[c]] += weight[c]
        titles[around[c]] += titles[c]
        inner[around[c]].append(c)
    at = 0
    while kind[at] != "article" and inner[at]:
        best = max(inner[at], key=lambda c: (weight[c], -c))
        if weight[best] < ENTER * weight[at] or titles[best] < titles[at] and kind[best] not in ("body", "article", "main"):
            break
        at = best
    return at


def dropped(names: list[list], lines: list[tuple], dense: np.ndarray) -> list[bool]:
    """Of each named element whether its lines go: its name is believed, or that of one around it."""
    n = len(names)
    heavy, all_chars, articles = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for (text, *_, name, article), d in zip(lines, dense):
        while name >= 0:
            heavy[name] += len(text) * bool(d)
            all_chars[name] += len(text)
            articles[name] += article
            name = names[name][2]
    talk = np.zeros(n, bool)
    for k, (says, _, around) in enumerate(names):  # outer ones come first
        talk[k] = says == "talk" or around >= 0 and talk[around]
    page = sum(len(line[0]) for line, d in zip(lines, dense) if d and (line[5] < 0 or not talk[line[5]]))
    in_articles = sum(line[6] for line in lines if line[5] < 0 or not talk[line[5]])
    out: list[bool] = []
    for k, (says, holds, around) in enumerate(names):
        most = heavy[k] > max(MOST * page, LEAST) and articles[k] == in_articles
        sparse = heavy[k] <= MOST * all_chars[k]
        believed = says == "talk" or not holds and not most and (says == "aside" or sparse)
        out.append(believed or around >= 0 and out[around])
    return out


def extract(html: str | None, sigma: float = 1.0, ratios: bool = True) -> str:
    """The page's content blocks in page order, joined by two newlines. Without ``ratios``
    every line counts as dense."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    lines = p.lines
    if not lines:
        return ""
    dense = np.ones(len(lines), bool)
    if ratios:
        level = smooth(np.log1p([len(line[0]) / line[1] for line in lines]), sigma)
        dense = level >= threshold(level)
    out = dropped(p.names, lines, dense)
    kept = [k for k, line in enumerate(lines) if line[5] < 0 or not out[line[5]]]
    if not kept:
        return ""
    lines = [lines[k] for k in kept]
    if ratios:  # the content's own clusters, without what names took away
        level = smooth(np.log1p([len(line[0]) / line[1] for line in lines]), sigma)
        dense = level >= threshold(level)
    else:
        dense = np.ones(len(lines), bool)
    chosen, inside = selected(lines, p.around, p.kind, dense), [True] * len(p.around)
    for c in range(len(p.around)):
        inside[c] = c == chosen or c > chosen and inside[p.around[c]] and p.around[c] != c
    return "\n\n".join(text for (text, _, linked, c, heading, *_), d in zip(lines, dense) if inside[c] and (d or heading or linked < LINKED * len(text)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
