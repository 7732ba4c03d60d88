"""Main text of HTML pages by text-to-tag ratio.

Parser events of the standard library are streamed into *lines*: one for each block of text, with the
number of tags met since the last, the characters inside links, and the containers it stands in. Each piece of a line
knows the marked containers that hold it, so that an advert inside a paragraph leaves the paragraph's own text.

Marks weigh text. Scripts, styles and the like are no text. What stands in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, told by the element or by a whole token of class, id or role (``share-buttons``), counts nothing. A token
that names such a thing beside other words (``related-work``, ``with-sidebar``) is a doubt, under which text counts half. A
mark is void where its container holds half of the text of the page's articles: then it describes a wrapper. On a page without
article or main, marks of classes and forms are void where nothing else is left.

The ratios of text to tags are smoothed by a Gaussian over neighbouring lines; what lies above a threshold (a share of the
standard deviation, or of the mean where ratios are even) forms clusters. The clusters choose the content region, the innermost
container with most of their text, or the article that it is a part of; where several articles share it, those that they touch. Lines
of the region stay, short ones too. Containers in doubt stay where clusters hold most of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements that begin and end a block; fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements whose text is no text of the page; fixed values.
NEVER = frozenset("head script style noscript template button select option textarea iframe object svg canvas label input audio video map datalist".split())
#: Elements that mark what they hold; fixed values.
ASIDE = frozenset("nav footer aside form dialog menu".split())
#: Words of class, id and role that name boilerplate; fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar sidebars complementary widget widgets menu menus nav navbar navigation navigational breadcrumb breadcrumbs footer contentinfo masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search comment comments commentlist respond replies reply disqus pagination pager skip".split()
)
#: Words that may stand beside them in a token without changing its sense; fixed values.
BESIDE = frozenset("area bar bottom box button buttons container content form group header icon icons inner item items left link links list main outer panel post posts right section site slot title top unit wrap wrapper".split())
#: Words that name boilerplate or a part of an article; fixed values.
DOUBTFUL = frozenset("aside copyright disclaimer discussion header hidden legal".split())
#: Words that mark an ``article`` element of a list or of a reader; fixed values.
NO_ARTICLE = frozenset("ad ads comment comments promo related reply sponsored teaser".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none")
_INNER = frozenset("article main section div td body".split())


class Held:
    """An open element; ``mark``: the innermost marked one that holds it or is it, 0 for none; ``never``: its text is no text."""

    __slots__ = ("name", "number", "never", "mark")

    def __init__(self, name: str, number: int, never: bool, mark: int):
        self.name, self.number, self.never, self.mark = name, number, never, mark


class Mark:
    """A marked container. ``kind``: 3 by its element, 2 by its class, 1 in doubt; ``articles``: text of articles inside."""

    __slots__ = ("above", "kind", "articles")

    def __init__(self, above: int, kind: int):
        self.above, self.kind, self.articles = above, kind, 0


class LineParser(HTMLParser):
    """Collects lines: (pieces, tags, containers), a piece being (data, mark, whether in a link). What is no text gives an empty line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Held] = []
        self.marks = [Mark(0, 0)]
        self.lines: list[tuple[list[tuple[str, int, bool]], int, tuple[tuple[str, int], ...]]] = []
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = self.links = self.number = self.article_text = 0
        self.article: tuple[int, int] | None = None  # the outermost open article: its number, and the mark that holds it
        self.dropped = self.has_article = False

    def _flush(self) -> None:
        if self.dropped or any(not p[0].isspace() for p in self.parts):
            path = tuple((x.name, x.number) for x in self.stack if x.name in _INNER)
            self.lines.append((self.parts, max(1, self.tags), path))
            self.tags = 0
        self.parts = []
        self.dropped = False

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """4 no text, 3 marked by its element, 2 by its class, 1 in doubt, 0 none of these."""
        if tag in NEVER:
            return 4
        if tag in ASIDE:
            return 2 if tag == "form" else 3
        if tag == "header":
            return 0 if any(x.name == "article" for x in self.stack) else 3
        if not attrs or tag in ("html", "body", "main"):
            return 0
        said = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-hidden")}
        if "hidden" in said or said.get("aria-hidden") == "true" or _NONE.search(said.get("style", "")):
            return 3
        tokens = " ".join(said.get(k, "") for k in ("class", "id", "role")).split()
        if tag == "article":
            return 2 if NO_ARTICLE.intersection(tokens) else 0
        kind = 0
        for token in tokens:
            words = {w for w in _WORDS.findall(token) if len(w) > 1}
            if words & MARKS:
                kind = max(kind, 2 if words <= MARKS | BESIDE else 1)
            elif words & DOUBTFUL:
                kind = max(kind, 1)
        return kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in ("br", "td", "th", "hr"):
            self.parts.append((" ", 0, False))
        kind = 0 if tag in VOID else self._kind(tag, attrs)
        if tag in BLOCKS:
            self._flush()
        under = bool(self.stack) and (self.stack[-1].never or self.stack[-1].mark > 0)  # where each end must find its begin
        if tag in VOID or not (kind or under or tag in BLOCKS or tag in _INNER):
            return
        if tag in ("p", "li", "dd", "dt", "option", "tr"):  # these end where the next of their kind begins
            if self.stack and self.stack[-1].name == tag:
                self._close(len(self.stack) - 1)
        if tag == "body":
            while self.stack and self.stack[-1].name == "head":
                self._close(len(self.stack) - 1)
        if tag in ("article", "main"):  # a menu or page header left open ends here
            for k, x in enumerate(self.stack):
                if x.name in ("nav", "header", "head"):
                    self._close(k)
                    break
        never, mark = (self.stack[-1].never, self.stack[-1].mark) if self.stack else (False, 0)
        self.number += 1
        if tag in ("article", "main") and not kind:
            self.has_article = True
            if self.article is None:
                self.article, self.article_text = (self.number, mark), 0
        if 0 < kind < 4:
            self.marks.append(Mark(mark, kind))
            mark = len(self.marks) - 1
        self.stack.append(Held(tag, self.number, never or kind == 4, mark))

    def _close(self, k: int) -> None:
        """Ends the open elements from place ``k`` on."""
        if self.article is not None and any(x.number == self.article[0] for x in self.stack[k:]):
            mark = self.article[1]
            self.marks[0].articles += self.article_text
            while mark:
                self.marks[mark].articles += self.article_text
                mark = self.marks[mark].above
            self.article = None
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == tag:
                self._close(k)
                break

    def handle_data(self, data: str) -> None:
        mark = 0
        if self.stack:
            if self.stack[-1].never:
                self.dropped = self.dropped or not data.isspace()
                return
            mark = self.stack[-1].mark
        self.parts.append((data, mark, self.links > 0))
        if self.article is not None:
            self.article_text += len(data)

    def close(self) -> None:
        super().close()
        self._flush()
        self._close(0)


def weighed(parser: LineParser) -> list[tuple[str, int, int, tuple[tuple[str, int], ...], int]]:
    """(text, tags, link characters, containers, container in doubt or 0) of each line; what is marked is no text."""
    marks, half = parser.marks, parser.marks[0].articles / 2

    def lines_of(void_classes: bool) -> list:
        told = [(False, 0)]  # of each mark: whether its text counts nothing; the outermost doubt
        for k, mark in enumerate(marks[1:], 1):
            none, doubt = told[mark.above]
            void = (mark.articles >= half > 0) or (void_classes and mark.kind < 3)
            told.append((none or (mark.kind > 1 and not void), doubt or (k if mark.kind == 1 and not void else 0)))
        out = []
        for pieces, tags, path in parser.lines:
            kept = [p for p in pieces if not told[p[1]][0]]
            text = " ".join("".join([p[0] for p in kept]).split())
            doubt = next((told[p[1]][1] for p in kept if told[p[1]][1] and not p[0].isspace()), 0)
            out.append((text, tags, min(sum(len(p[0].strip()) for p in kept if p[2]), len(text)), path, doubt))
        return out

    lines = lines_of(False)
    return lines if parser.has_article or any(x[0] for x in lines) else lines_of(True)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside go to the others."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def clusters(lines: list, sigma: float, share: float) -> np.ndarray:
    """Whether each line is in a cluster."""
    ratios = np.array([(len(x[0]) - x[2]) / x[1] / (2 if x[4] else 1) for x in lines])
    level = smooth(ratios, sigma)
    chosen = (level >= min(share * level.std(), level.mean())) & (ratios > 0)
    return chosen if chosen.any() else np.array([bool(x[0]) for x in lines])


def content(html: str, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of one page; '' for a page without any."""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = weighed(parser)
    if not any(x[0] for x in lines):
        return ""
    chosen = clusters(lines, sigma, share).tolist()
    held: dict[tuple[str, int], int] = {}
    doubts: dict[int, list[int]] = {}
    for line, hit in zip(lines, chosen):
        if line[4]:
            seen = doubts.setdefault(line[4], [0, 0])
            seen[0] += len(line[0]) if hit else 0
            seen[1] += len(line[0])
        if hit:
            for container in line[3]:
                held[container] = held.get(container, 0) + len(line[0])
    out = {k for k, (hit, all_) in doubts.items() if 2 * hit <= all_}
    region = _region(lines, held, sum(len(x[0]) for x, hit in zip(lines, chosen) if hit))
    return "\n".join(x[0] for x in lines if x[0] and x[4] not in out and (region is None or not region.isdisjoint(x[3])))


def _region(lines: list, held: dict[tuple[str, int], int], total: int) -> set[tuple[str, int]] | None:
    """The containers whose lines stay; None for the whole page. ``held``: clusters' text in each container, ``total``: all of it."""
    most = [c for c, n in held.items() if n >= 0.6 * total]
    inner = max(most, key=lambda c: c[1], default=None)
    around = [c for c in most if c[0] in ("article", "main")]
    if any(c[0] == "article" for c in around):
        return {min((c for c in around if c[0] == "article"), key=lambda c: c[1])}  # an article inside another is a part of it
    articles = {c for c in held if c[0] == "article"}
    if sum(len(x[0]) for x in lines if not articles.isdisjoint(x[3])) >= 0.6 * total and articles:
        return articles
    return {around[0]} if around else None if inner is None else {inner}


def extract_main_text(pages: DataFrame, html_col: str = "html", sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """``pages`` without the html, with ``text`` (replaced where there is one).

    Null or empty html gives ''. Pages of any length are parsed whole, in memory in proportion to the page. Rows are
    taken one by one, so that ties, repeated rows and null ids change nothing; an empty table gives no row.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [content(h, sigma, share) for h in frame.text]
            yield frame

    return rows.mapInPandas(run, rows.schema)


def contract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; see ``extract_main_text`` for odd rows."""
    done = extract_main_text(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
