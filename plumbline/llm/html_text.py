"""Main text of web pages, from streamed parser events.

The standard library's parser is fed in slices. Its events become lines: one
per block, with the characters of its text outside links, the tags met since the
line before, and where it stands. The ratio of text to tags along the page, as a
logarithm, is smoothed with a Gaussian and split in two by threshold clustering.

Dense lines choose the content region: the articles that hold some, or the rest of
the main part, or the innermost holder in the plain page, whichever of the three
holds most dense text. A region is kept whole but for runs of lines that are links
alone and not dense. What an element declares to be a menu, header, footer,
sidebar, notice, advert, form or reader comments is markup: its ratio is zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 1 << 16
SIGMA = 1.5
#: Lines in a row that are links alone make a menu, if they are not dense.
MENU_LINES = 3
#: Share of the dense text that the region of a page without landmarks holds.
HELD_SHARE = 0.8

RESULT = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text, and those that do not outside the article.
NEVER = frozenset("script style title noscript template iframe object svg math canvas audio video nav aside footer form button select textarea menu dialog datalist".split())
OUTSIDE = frozenset(("header", "hgroup"))
#: Elements that an element of a kind closes without an end tag.
SIBLINGS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CLOSES_P = BLOCKS - {"body", "html"}
HOLDERS = frozenset("article main section div td body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that mark such a block, when all other words of that name only say where it is or what it is made of.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comment comments commentlist reply replies disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login search form toolbar widget".split()
)
QUALIFIERS = frozenset(
    "site page main top bottom left right side global primary secondary reader readers user users post posts article articles list box block section area container "
    "wrapper wrap inner outer group row col column bar button buttons icon icons link links media item items slot unit panel header title body content text small large "
    "sticky fixed inline mobile desktop js is has id no the".split()
)
#: Words that do so outside the article only.
OUTSIDE_HINTS = frozenset("header masthead topbar topnav".split())
_HINT_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Turns parser events into lines ``(text, tags, masked, landmark, holder, characters outside links)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, int]] = []
        self.holders = [-1]  # parent of each holder
        # open elements: tag, masked, landmark, holder
        self.open: list[tuple[str, bool, int, int]] = [("", False, -1, 0)]
        self.words: list[str] = []
        self.plain = 0  # characters of the line outside links, white space not counted
        self.links = 0  # open links
        self.tags = 0
        self.kinds: list[str] = []  # element of each landmark

    def _end_line(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                _, masked, landmark, holder = self.open[-1]
                self.lines.append((text, self.tags, masked, landmark, holder, self.plain))
                self.tags = 0
            self.words, self.plain = [], 0

    def _masks(self, tag: str, attrs: list, inside: bool) -> bool:
        if tag in NEVER or (tag in OUTSIDE and not inside):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                return True
            if name == "role" and value and value.lower() in ROLES:
                return True
            if name in ("class", "id") and value:
                for own in value.split():
                    words = {w.lower() for w in _HINT_WORDS.findall(own)}
                    hints = words & (HINTS if inside else HINTS | OUTSIDE_HINTS)
                    if hints and words - hints <= QUALIFIERS:
                        return True
        return False

    @staticmethod
    def _landmark(tag: str, attrs: list) -> bool:
        """Does the element say that it holds the main text?"""
        return tag in ("article", "main") or any((name == "role" and value in ("main", "article")) or (name == "itemprop" and value == "articleBody") for name, value in attrs)

    def _pop_to(self, depth: int) -> None:
        self._end_line()
        self.links -= sum(x[0] == "a" for x in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag in VOID and tag != "hr":
            self.tags += 1
            self.words.append(" ")
            return
        if tag in BLOCKS:
            self._end_line()
            if tag in CLOSES_P:
                for depth in range(len(self.open) - 1, 0, -1):
                    if self.open[depth][0] == "p":
                        self._pop_to(depth)
                        break
                    if self.open[depth][0] in HOLDERS:
                        break
            if self.open[-1][0] in SIBLINGS.get(tag, ()):
                self._pop_to(len(self.open) - 1)
        elif tag in NEVER:
            self._end_line() if tag in ("textarea", "select", "iframe") else None
        self.tags += 1
        if tag == "hr":
            return
        _, masked, landmark, holder = self.open[-1]
        hides = self._masks(tag, attrs, landmark >= 0)
        if hides and not masked:
            self._end_line()
        if not (masked or hides) and self._landmark(tag, attrs) and (landmark < 0 or tag == "article" and self.kinds[landmark] != "article"):
            self.kinds.append(tag)  # an article within the main part is told apart from it, but not a body within its article
            landmark = len(self.kinds) - 1
        if tag in HOLDERS:
            self.holders.append(holder)
            holder = len(self.holders) - 1
        self.links += tag == "a"
        self.open.append((tag, masked or hides, landmark, holder))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.open) - 1, 0, -1):
            name, masked, _, _ = self.open[depth]
            if name == tag:
                if tag in BLOCKS or tag in HOLDERS or masked:
                    self._pop_to(depth)
                else:
                    self.links -= tag == "a"
                    del self.open[depth]  # an inline element; those opened inside stay open
                return
            if name in HOLDERS and tag not in HOLDERS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if not self.links:
            self.plain += sum(map(len, data.split()))

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def ratios(lines: list) -> np.ndarray:
    """Logarithm of the characters for each tag of every line; nothing for links and for what is marked as no content."""
    return np.log1p([0.0 if masked else plain / max(1, tags) for _, tags, masked, _, _, plain in lines])


def dense(ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed ratios, and the threshold between two clusters of them.

    The lower cluster is that of plain markup, whose centre is zero; the upper
    one's centre is the mean of its members, from the largest ratio on.
    """
    smooth = smoothed(ratio)
    centre = float(smooth.max())
    for _ in range(50):
        new = float(smooth[smooth >= centre / 2].mean())
        if new == centre:
            break
        centre = new
    return smooth, centre / 2


def main_text(html: str) -> str:
    """The main text of one page; its blocks stand on lines of their own."""
    parser = _Lines()
    for start in range(0, len(html), SLICE_CHARS):
        parser.feed(html[start : start + SLICE_CHARS])
    parser.close()
    lines = parser.lines
    free = [i for i, line in enumerate(lines) if not line[2]]
    if not free:
        return ""
    ratio = ratios(lines)
    smooth, threshold = dense(ratio)
    strong = np.maximum(smooth, ratio) >= threshold
    return "\n".join(lines[i][0] for i in _without_menus(lines, _content(parser, free, strong), ratio, smooth, threshold))


def _content(parser: _Lines, free: list[int], strong: np.ndarray) -> list[int]:
    """Lines of the regions that hold most of the dense text."""
    lines = parser.lines
    places: list[list[int]] = [[], [], []]  # in articles, elsewhere in the main part, elsewhere in the page
    for i in free:
        landmark = lines[i][3]
        places[2 if landmark < 0 else parser.kinds[landmark] != "article"].append(i)
    mass = [sum(len(lines[i][0]) for i in place if strong[i]) for place in places]
    if not any(mass):
        return next(place for place in places if place)  # links alone
    best = mass.index(max(mass))
    if best == 2:
        return _region(lines, places[2], strong, parser.holders)
    held = {lines[i][3] for i in places[best] if strong[i]}
    return [i for i in places[best] if lines[i][3] in held]


def _without_menus(lines: list, chosen: list[int], ratio: np.ndarray, smooth: np.ndarray, threshold: float) -> list[int]:
    """``chosen`` without runs of MENU_LINES and more lines that are links alone and sparse on the whole."""
    out = []
    for links, run in groupby(chosen, lambda i: ratio[i] == 0 and threshold > 0):
        run = list(run)
        if not (links and len(run) >= MENU_LINES and smooth[run].mean() < threshold):
            out += run
    return out


def _region(lines: list, free: list[int], strong: np.ndarray, parents: list[int]) -> list[int]:
    """Without landmarks: the innermost holder of most dense text, from its first dense line to its last."""
    seeds = [i for i in free if strong[i]]
    if not seeds:
        return []
    held: dict[int, int] = {}
    for i in seeds:
        holder = lines[i][4]
        while holder >= 0:
            held[holder] = held.get(holder, 0) + len(lines[i][0])
            holder = parents[holder]
    need = HELD_SHARE * sum(len(lines[i][0]) for i in seeds)
    best = max(h for h, n in held.items() if n >= need)  # holders are numbered as they open: the last is the innermost

    def within(i: int) -> bool:
        holder = lines[i][4]
        while holder >= 0 and holder != best:
            holder = parents[holder]
        return holder == best

    kept = [i for i in seeds if within(i)]
    return [i for i in free if kept[0] <= i <= kept[-1] and within(i)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py() or "") for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, from its whole html.

    A null or empty html, or one without main text, gives an empty text; null
    ids and urls stay null; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(_extract, RESULT)
