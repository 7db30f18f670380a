"""Main text of web pages from parser events and text-to-tag ratios (operator 8).

A page streams through the standard library's HTML parser. Its events cut the
page into lines, one per block of text, and count the characters and tags of
each. Then

1. the text-to-tag ratio of every line is smoothed along the page with a
   Gaussian kernel, and lines whose smoothed ratio is over a threshold (the
   mean of the two cluster centres that one-dimensional 2-means finds) are
   content;
2. the content region is the article: the ``article`` or ``main`` elements
   that hold content lines, with those they are in and those beside them, or,
   without any, the smallest element that holds all content lines (lists of
   links do not widen it);
3. every line of the region is kept, short ones too, but for those inside
   elements that are never content: menus, headers, footers, sidebars,
   notices, adverts, forms, comments, scripts, styles, hidden parts. A word of
   a class or id, or a form, makes no such element of one that holds the
   article, a ``main`` or most of the content lines' text: that is decided when
   the whole page is read, from its lines' ratios.

White space inside a line becomes one space, character references are decoded,
and lines are joined by a line feed. Nothing else is dropped or cut.

Every page is handled by itself: no shuffle, and memory for one page.

Defined cases: null and empty html give an empty text; a page without text
outside boilerplate gives an empty text; broken markup (unclosed tags, an end
inside a tag) is read as far as the parser gets; a null page_id or url stays
null; repeated rows are extracted each; further columns are ignored by
``extract``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr img".split())
BOILERPLATE = frozenset("head title script style noscript template nav footer aside button select option textarea "
                        "input iframe object svg canvas menu dialog".split())
#: boilerplate unless they hold the page's content, like elements with a word of NAMES
FORMS = frozenset(("form", "fieldset"))
ARTICLE = frozenset(("article", "main"))
#: an element of these that is open when another of them starts, inside the same parent, has ended
IMPLIED_END = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
               "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
BLOCK_ENDS_P = {"p"}
#: blocks of text, which are no regions of their own
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre ul ol dl blockquote figcaption caption address summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: words of class and id values
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation "
                  "menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices popup "
                  "modal overlay newsletter subscribe subscription share sharing social comment comments respond reply "
                  "replies disqus related recommended pagination pager toolbar widget widgets login signup".split())
#: words of NAMES for text of other authors or articles, which may be longer than the article's own
OTHERS = frozenset("comment comments respond reply replies disqus related recommended".split())
#: a word of NAMES behind one of these tells what an element has, not what it is (has-sidebar)
HAVING = frozenset("has with no without hide".split())
KEEP = frozenset(("html", "body", "article", "main"))
#: a named element is content if it holds such a share of the content text inside it and outside all named elements
SHARE, SHARE_ARTICLE, SHARE_OTHERS = 0.75, 0.5, 0.95


#: an article beside the chosen ones with fewer lines, links aside, and without a content line is a teaser
TEASER = 3


class Line:
    __slots__ = ("text", "tags", "links", "region", "boilerplate", "article")

    def __init__(self, region: int, boilerplate: bool, article: int):
        self.text: list[tuple[str, int]] = []  # with the innermost named element around it
        self.tags = self.links = 0  # links: characters inside a elements
        self.region, self.boilerplate, self.article = region, boilerplate, article

    def is_links(self) -> bool:
        """More than half of the text is links."""
        return 2 * self.links > sum(len("".join(t.split())) for t, _ in self.text)

    def without(self, named: set[int]) -> str:
        """The text outside the ``named`` elements."""
        return " ".join("".join(t for t, mark in self.text if mark not in named).split())


class Open(NamedTuple):
    tag: str = ""
    region: int = 0  # the innermost open element that is no leaf
    boilerplate: bool = False
    article: int = 0
    named: int = 0  # the innermost open named element


class Article(NamedTuple):
    parent: int  # the element around it
    around: int  # the article or main it is in
    named: int


class Lines(HTMLParser):
    """Cuts a page into lines. A line, an article and a named element know the element around them by its number, and
    that the next one: nothing holds a path, so memory is linear however deep a page's elements lie. An element's
    number is larger than those of the elements around it.

    What is boilerplate by element, role or style is so at once. Elements that are so by a word of their class or id, or
    as forms, are only numbered (``named``): a wrapper of the whole page may have such a word.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.count = 0
        self.having: Counter[str] = Counter()  # open elements by tag
        self.above: dict[int, int] = {0: 0}  # the region around each
        self.named: dict[int, tuple[int, int]] = {}  # with the named element and the article around each
        self.others: set[int] = set()
        self.articles: dict[int, Article] = {}
        self.mains: set[int] = set()
        self.link = False  # inside an a element; a block in it does not end it
        self.cut()

    def inside(self) -> Open:
        return self.open[-1] if self.open else Open()

    def cut(self) -> None:
        if self.lines and not self.lines[-1].text:
            self.lines.pop()
        top = self.inside()
        self.lines.append(Line(top.region, top.boilerplate, top.article))

    @staticmethod
    def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
        if tag in BOILERPLATE or tag == "header" and not in_article:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    @staticmethod
    def names(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        """What makes an element boilerplate unless it holds the content."""
        found = {"form"} if tag in FORMS else set()
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role" and value == "form":
                found.add("form")
            if name in ("class", "id"):
                for one in value.split():
                    words = re.split(r"[^a-z0-9]+", one)
                    found |= {w for before, w in zip(["", *words], words) if w in NAMES and before not in HAVING}
        if tag in KEEP:
            found &= {"comment", "comments"} if tag == "article" else set()
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.lines[-1].text.append((" ", 0))
            elif tag == "hr":
                self.cut()
            self.lines[-1].tags += 1
            return
        inside = self.inside()
        if tag == "a":
            self.link = any(name == "href" for name, _ in attrs)
        if tag in INLINE:
            if inside.tag == tag and (inside.boilerplate or inside.named):
                self.push(tag, inside.boilerplate, set())
            elif attrs and not inside.boilerplate:
                bad, names = self.is_boilerplate(tag, attrs, inside.article > 0), self.names(tag, attrs)
                if bad or names:
                    self.push(tag, bad, names)  # an inline advert or a hidden span
            self.lines[-1].tags += 1
            return
        ends = IMPLIED_END.get(tag, BLOCK_ENDS_P)
        while self.open and self.open[-1].tag in ends:
            self.having[self.open.pop().tag] -= 1
        inside = self.inside()
        self.push(tag, inside.boilerplate or self.is_boilerplate(tag, attrs, inside.article > 0), self.names(tag, attrs))
        self.cut()
        self.lines[-1].tags += 1

    def push(self, tag: str, boilerplate: bool, names: set[str]) -> None:
        inside = self.inside()
        self.count += 1
        n, named, article, region = self.count, inside.named, inside.article, inside.region
        if names and not boilerplate:
            self.named[n] = named, article
            named = n
            if names & OTHERS:
                self.others.add(n)
        if tag in ARTICLE and not boilerplate:
            self.articles[n] = Article(region, article, named)
            if tag == "main":
                self.mains.add(n)
            article = n
        if tag not in LEAF:
            self.above[n] = region
            region = n
        self.open.append(Open(tag, region, boilerplate, article, named))
        self.having[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements but void ones

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        for i in range(len(self.open) - 1, -1, -1) if self.having[tag] else ():
            if self.open[i].tag == tag:
                self.having.subtract(x.tag for x in self.open[i:])
                del self.open[i:]
                if tag not in INLINE:
                    self.cut()
                break
            if tag in INLINE or self.open[i].tag in ("article", "main", "body", "table", "td") and tag in ("p", "li"):
                break  # it was not pushed, or ended by itself
        self.lines[-1].tags += 1

    def handle_data(self, data: str) -> None:
        top = self.inside()
        if not (top.boilerplate and top.tag in INLINE):
            self.lines[-1].text.append((data, top.named))
            if self.link:
                self.lines[-1].links += len("".join(data.split()))

    def around(self, articles: set[int]) -> set[int]:
        """The articles and those they are in."""
        out: set[int] = set()
        for a in articles:
            while a and a not in out:
                out.add(a)
                a = self.articles[a].around
        return out

    def within(self, marked: set[int]) -> set[int]:
        """The named elements that are marked or lie in one that is."""
        out: set[int] = set()
        for e, (around, _) in self.named.items():  # outer ones first
            if e in marked or around in out:
                out.add(e)
        return out

    def common_region(self, regions: set[int]) -> int:
        """The innermost element that holds all of the elements."""
        held = Counter(regions)
        for n in reversed(self.above):  # inner ones first
            if held[n] == len(regions):
                return n
            held[self.above[n]] += held[n]
        return 0

    def in_region(self, region: int) -> set[int]:
        """The element and all in it."""
        out = {region}
        for n, up in self.above.items():  # outer ones first
            if up in out and n:
                out.add(n)
        return out


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma ** 2))
    weight = np.convolve(np.ones(len(x)), kernel, "full")[r:r + len(x)]
    return np.convolve(x, kernel, "full")[r:r + len(x)] / weight


def threshold(x: np.ndarray) -> float:
    """The middle of the two centres of a one-dimensional 2-means."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        mid = (low + high) / 2
        a, b = x[x <= mid], x[x > mid]
        if not len(b):
            break
        new = float(a.mean()), float(b.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list[Line], texts: list[str], bad: list[bool], sigma: float) -> tuple[list[int], list[int]]:
    """The lines whose smoothed text-to-tag ratio is over the threshold, of those that are not ``bad``; and of these, those
    whose own ratio is, which are not only near such a line."""
    ratio = np.array([0.0 if b else len(t) / max(1, x.tags) for x, t, b in zip(lines, texts, bad)])
    fine = [i for i, b in enumerate(bad) if not b]
    flat = smoothed(ratio, sigma)
    least = threshold(flat)
    found = [i for i in fine if flat[i] >= least] or fine
    return found, [i for i in found if ratio[i] >= least]


def boilerplate_elements(parser: Lines, lines: list[Line], sigma: float) -> set[int]:
    """The named elements but for those that hold the page's article or most of its content text."""
    if not parser.named:
        return set()
    texts = [x.without(set()) for x in lines]
    bad = [x.boilerplate for x in lines]
    if all(bad):
        return set(parser.named)
    content = set(content_lines(lines, texts, bad, sigma)[0])
    # characters right in each named element (0: in none), and in it with the named elements it holds
    own: dict[int, int] = defaultdict(int)
    in_article: set[int] = set()
    for i, x in enumerate(lines):
        if x.boilerplate:
            continue
        for t, mark in x.text:
            if n := len("".join(t.split())):
                if i in content:
                    own[mark] += n
                if x.article:
                    in_article.add(mark)
    articles = parser.around({x.article for x in lines if not x.boilerplate}) - parser.named.keys()  # no comments
    holds_article = {parser.articles[a].named for a in articles}
    holds_main = {parser.articles[a].named for a in articles & parser.mains}
    holds = defaultdict(int, own)
    for e in sorted(parser.named, reverse=True):  # inner ones first
        around = parser.named[e][0]
        holds[around] += holds[e]
        for held in (holds_article, holds_main):
            if e in held:
                held.add(around)
    total = sum(own.values())
    marked: set[int] = set()
    # of what is around each: characters, whether an article has text there, whether it is marked
    outside: dict[int, tuple[int, bool, bool]] = {0: (0, False, False)}
    for e, (around, article) in parser.named.items():  # outer ones first
        rest, article_outside, gone = outside[around]
        rest, article_outside, gone = rest + own[around], article_outside or around in in_article, gone or around in marked
        outside[e] = rest, article_outside, gone
        share = holds[e] / max(1, holds[e] + rest)
        if gone:
            keep = False
        elif e in holds_main:
            keep = True
        elif e in holds_article and (not article_outside or holds[e] > rest):
            keep = share > (SHARE_OTHERS if e in parser.others else SHARE_ARTICLE)
        elif article_outside and not article:
            keep = False
        else:
            keep = 2 * holds[e] > total and share > (SHARE_OTHERS if e in parser.others else SHARE)
        if not keep:
            marked.add(e)
    return parser.within(marked)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(re.sub(r"<[a-zA-Z/!?][^<>]*$", "", html))  # a tag that the page's end cuts is no text
    parser.close()
    lines = [x for x in parser.lines if x.without(set())]
    marked = boilerplate_elements(parser, lines, sigma)
    texts = [x.without(marked) for x in lines]
    bad = [x.boilerplate or not t for x, t in zip(lines, texts)]
    fine = [i for i, b in enumerate(bad) if not b]
    if not fine:
        return ""
    content, own = content_lines(lines, texts, bad, sigma)
    articles = {lines[i].article for i in own if not lines[i].is_links()} - {0} or {lines[i].article for i in content} - {0}
    if not articles:
        articles = {lines[i].article for i in fine} - {0}
    if articles:
        # all that an article or main encloses belongs to it, and the articles beside it are parts of the same text, but
        # for teasers: a line or two of which none is content, or links
        articles = parser.around(articles)
        parents = {parser.articles[a].parent for a in articles}
        plain: Counter[int] = Counter()
        good = set(own)
        for i in fine:
            if not lines[i].is_links():
                plain[lines[i].article] += TEASER if i in good else 1
        articles |= {a for a, x in parser.articles.items() if x.parent in parents and a not in marked and plain[a] >= TEASER}
        for a, x in parser.articles.items():  # outer ones first
            if x.around in articles:
                articles.add(a)
        kept = [i for i in fine if lines[i].article in articles]
    else:
        # a long paragraph puts the threshold above short ones: lines of their size, not of that of menus, count too
        size = np.array([np.log1p(len(texts[i]) / max(1, lines[i].tags)) for i in fine])
        least = threshold(size)
        wide = [i for i in content if not lines[i].is_links()] or content
        wide = sorted({*wide, *(i for i, x in zip(fine, size) if x >= least and not lines[i].is_links())})
        region = parser.in_region(parser.common_region({lines[i].region for i in wide}))
        kept = [i for i in fine if lines[i].region in region]
    return "\n".join(texts[i] for i in kept)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py(), sigma) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(rows, "page_id long, url string, text string, n_chars long"))
