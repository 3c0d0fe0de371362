"""HTML main-text extraction from streaming parser events by text-to-tag ratio (after Weninger, Hsu and Han, WWW 2010).

Every block of a page is a line with a text-to-tag ratio. What surrounds a line is evidence that weighs on its ratio, by
powers of two: an article or main element for it, a class or id that speaks of adverts against it, a menu or footer more
so. Ratios are smoothed by a Gaussian along the lines of one region, a stretch of the page under the same evidence, so
that short lines stand with the long ones around them. The smoothed, weighted ratios of a page then fall into clusters
on a logarithmic scale, and the topmost one is the content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements whose content is not text of the page.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
#: What a head may hold; anything else ends one that was not closed.
HEAD = frozenset("title script style noscript template base link meta object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOX = frozenset("div section article main td table ul ol header".split())
#: Elements that hold something else than the article, and controls of forms.
SIDE = frozenset("nav footer aside menu dialog button select option textarea label".split())
#: Words in class, id or role that mark menus, headers, notices, adverts, forms, sidebars and reader comments.
MARK = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip sidebar aside widget related recommended trending share sharing social comment comments commentlist replies reply respond "
    "discussion disqus footer foot masthead topbar search complementary contentinfo alert alertdialog form".split()
)
#: A name with one of these says what a content element has or lacks beside it.
BESIDE = frozenset("has with no without layout".split())
#: Marks that a section of an article can be about, as its id says, and those of them that also mean other things in a class
#: of several words. In an article they count with a word of BUILT, or with nothing but marks beside them.
PLAIN = frozenset("form search discussion notice alert related foot promotion navigation menu".split())
TOPIC = MARK - frozenset("ad ads advert adverts comments commentlist replies respond disqus sidebar aside widget navbar masthead topbar breadcrumb breadcrumbs pagination pager toolbar".split())
BUILT = frozenset("list box bar button buttons icons links posts articles stories items content reading area container wrapper widget form thread block panel banner".split())

#: Evidence, as powers of two that a ratio is multiplied by.
ARTICLE, MARKED, TWICE, SIDEWAYS, LINKS = 20.0, -20.0, -40.0, -90.0, -20.0
#: Lines further apart than this, in powers of two, are of different clusters; nothing under the floor is content.
GAP, FLOOR = 5.0, -50.0


@lru_cache(1 << 14)
def marked(names: str, in_article: bool, anchor: bool = False) -> bool:
    """Whether a class, id or role names something that is no part of the article. Outside an article a header is, too.

    ``anchor``: the name is the id of a section in an article, which says what the section is about.
    """
    for name in names.lower().split():
        parts = re.split(r"[-_]+|(?<=[a-z])(?=\d)", name)
        found = MARK.intersection(parts)
        if in_article and (anchor and found <= TOPIC or len(parts) > 1 and found <= PLAIN):
            if not any(t != b for t in found for b in BUILT.intersection(parts)) and (len(parts) == 1 or len(found) < len(set(parts))):
                continue
        if not BESIDE.intersection(parts) and (found or not in_article and "header" in parts):
            return True
    return False


class Lines(HTMLParser):
    """Turns parser events into lines, one for each block.

    A line is its text, the tags in it, its evidence in powers of two, its region, its container, the characters of it
    that are links, and whether it is in an article. Looking up what is open takes the same time at any depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, what was in force before it, and whether it stands in the middle of a line of other evidence.
        self.open: list[tuple[str, tuple, bool]] = []
        self.count: Counter[str] = Counter()
        #: Where the open blocks are, and the inline elements open in each.
        self.blocks: list[int] = [-1]
        self.inline: list[Counter[str]] = [Counter()]
        # unseen, in an article, in a header, in a heading, in a link, marks counted, sideways, region
        self.state: tuple = (False, False, False, False, False, 0, False, 0)
        self.regions = 0
        self.words, self.tags, self.linked = [], 0, 0
        self.kept: list[tuple[list, int, int]] = []
        self.lines: list[tuple[str, int, float, int, int, int, bool]] = []
        self.box, self.boxes = [0], 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        unseen, article, header, heading, _, marks, sideways, region = self.state
        if text and not unseen:
            weight = ARTICLE * article + (0, MARKED, TWICE)[min(marks, 2)]
            if sideways or header and not (article and heading):
                weight += SIDEWAYS
            self.lines.append((text, self.tags, weight, region, self.box[-1], self.linked, article))
        self.words, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.words.append(" ")
        if self.open and self.open[-1][0] == "head" and tag not in HEAD:
            self.flush()
            self._pop(len(self.open) - 1)
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self.flush()
            return
        block = tag in BLOCK
        if block:
            self.flush()
        elif tag in ("td", "th"):
            self.words.append(" ")
        if tag in ("main", "article"):
            self._leave(tag)
        if tag == "p" or tag in HEADING or tag == "li":
            self._close_like(tag)
        unseen, article, header, heading, link, marks, sideways, region = before = self.state
        unseen |= tag in UNSEEN
        article |= tag in ("article", "main")
        header |= tag == "header"
        heading |= tag in HEADING
        link |= tag == "a"
        sideways |= tag in SIDE
        marks += tag == "form"
        if attrs and tag not in ("html", "body", "main"):
            named = False
            for k, v in attrs:
                if k in ("class", "id", "role") and v:
                    if article and k == "id" and (tag in HEADING or tag in ("a", "span")):
                        continue  # a link's target, named for the words there
                    named |= marked(v, article, k == "id" and tag == "section")
                    article |= k == "role" and v == "main"
                elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I):
                    sideways = True
            marks += named
        if (article, header, marks, sideways) != (before[1], before[2], before[5], before[6]):
            self.regions += 1
            region = self.regions
        aside = not block and (unseen, marks, sideways) != (before[0], before[5], before[6])
        if aside:  # in the middle of a line: what is in it becomes a line of its own
            self.kept.append((self.words, self.tags, self.linked))
            self.words, self.tags, self.linked = [], 0, 0
        self.open.append((tag, before, aside))
        self.count[tag] += 1
        if block or tag in ("td", "th"):
            self.blocks.append(len(self.open) - 1)
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.state = unseen, article, header, heading, link, marks, sideways, region
        if tag in BOX:
            self.boxes += 1
            self.box.append(self.boxes)
        self.tags += 1

    def _leave(self, tag: str) -> None:
        """An article ends menus, headers, footers and forms that were not closed; main ends all but the page."""
        ends = ("nav", "header", "footer", "head") if tag == "article" else None
        if ends and not any(self.count[e] for e in ends):
            return
        for i, (name, *_) in enumerate(self.open):
            if name in ends if ends else name not in ("html", "body", "form", "article"):
                self._pop(i)
                return

    def _close_like(self, tag: str) -> None:
        """A new p, heading or list item ends one that is open, with what is left open in it."""
        i = self.blocks[-1]
        if i >= 0:
            name = self.open[i][0]
            if name == tag or tag != "li" and (name == "p" or name in HEADING):
                self._pop(i)

    def _pop(self, i: int) -> None:
        """Ends element ``i`` and all in it."""
        while len(self.open) > i:
            name, before, aside = self.open.pop()
            self.count[name] -= 1
            if self.blocks[-1] == len(self.open):
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][name] -= 1
            if name in BOX and len(self.box) > 1:
                self.box.pop()
            if aside:
                self.flush()
                self.words, self.tags, self.linked = self.kept.pop()
            self.state = before

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag not in ("td", "th") and not self.inline[-1][tag]:
            return  # an inline end tag doesn't reach out of its block
        if self.count[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._pop(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if self.state[4]:
            self.linked += len(data)

    def end(self) -> None:
        self.flush()
        self._pop(0)
        self.flush()


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, the weights made to add up to 1 at the ends."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, w)[r : r + len(x)] / np.convolve(np.ones(len(x)), w)[r : r + len(x)]


def top_cluster(x: np.ndarray) -> np.ndarray:
    """Which values are in the topmost cluster: from the greatest down to the first gap wider than ``GAP``, and above ``FLOOR``."""
    order = np.sort(x)[::-1]
    wide = np.flatnonzero(order[:-1] - order[1:] > GAP)
    return (x >= (order[wide[0]] if len(wide) else order[-1])) & (x > FLOOR)


def select(lines: list[tuple], sigma: float) -> np.ndarray:
    """Which lines are content."""
    ratio = np.array([len(x[0]) / (x[1] + 1) for x in lines], float)
    region = np.array([x[3] for x in lines])
    order = np.argsort(region, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        ratio[part] = smooth(ratio[part], sigma)
    article = np.array([x[6] for x in lines])
    links = ~article & np.array([2 * x[5] > len(x[0]) for x in lines])
    content = top_cluster(np.log2(ratio) + np.array([x[2] for x in lines]) + LINKS * links)
    if not (content & article).any():  # without an article, containers with a line of a ratio that stands out, as a whole
        box = np.array([x[4] for x in lines])
        least = ratio[content].std() if content.any() else 0.0
        content &= np.isin(box, box[content & (ratio >= least)])
    return content


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page; see :func:`extract`."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"</?[a-zA-Z!?]", html[cut:]):
        html = html[:cut]  # a tag that the page ends in
    p = Lines()
    p.feed(html)
    p.close()
    p.end()
    if not p.lines:
        return ""
    return "\n\n".join(x[0] for x, k in zip(p.lines, select(p.lines, sigma), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """One row for each input row: ``page_id, url, text, n_chars``.

    The page is parsed as a stream; each block is a line, with its text and the tags it holds. Scripts, styles and the
    like have no text. The text-to-tag ratio of a line is smoothed by a Gaussian of ``sigma`` lines over the lines of its
    region, and weighted by evidence: 2**20 in an article or main element, 2**-20 in a form or under a class, id or role
    that speaks of adverts, notices, sharing or comments (2**-40 under two or more), 2**-90 in menus, footers, side bars,
    headers (but for an article's headings), controls or hidden parts, 2**-20 for a line mostly of links outside an
    article. The lines from the greatest weighted ratio down to the first gap of more than a factor 2**5 are the content;
    where none of them is in an article, only those in containers with a line whose ratio reaches the standard deviation.
    As evidence is relative, a page that is wholly in a form or a marked container loses nothing by that.

    In an article the id of a heading, link or span says nothing, and a name that an article can be about counts only if
    it says more: ``related-posts`` does, ``related-work`` and ``form-of-life`` don't. Character references are decoded,
    white space in a block is one space, and blocks are joined by two line feeds.

    Null, empty and text-less pages give the empty text. Pages of any length are parsed whole. Null identifiers and
    addresses and repeated rows pass through; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                texts = [main_text(h.as_py(), sigma) for h in c.column(2)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        release()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
