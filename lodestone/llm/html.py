"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser yields one line per block of text, with its tags and the characters that are in
links.  The ratio of text outside links to tags, smoothed with a Gaussian along the page, marks lines of running text:
those at or over the threshold, which is the lesser of the mean and the standard deviation of the smoothed ratios.
The marked text then decides three things.  It tells which elements that look like furniture are some: an element whose
tag or class says so is dropped unless it holds at least half of the marked text of the page (and of the text of its
articles, if there are any), and one whose class only contains such a word is dropped if most of its text is unmarked.  It votes for the content region: the innermost article
or main with half of it, or else the innermost box with 80 % and boxes around it that hold running text themselves.  And where the region is no article or main, its clusters
select content: marked lines, what stands between or beside them in their own boxes, and headings; lines apart from all
clusters and lists of links go.

Null, empty and textless pages give the empty text.  Lines of equal ratio are treated alike, and among equal boxes the
innermost, then the one with most text, then the first is the region.  Repeated rows give equal rows, an empty table none;
only the id, url and html columns are read.  Nothing is capped: pages of any length and depth take time in proportion to
their events.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements whose text never is content, and elements that are furniture unless they hold most of the page.
DROPPED = frozenset("head title script style noscript template button select option textarea iframe object svg canvas menu dialog".split())
LIKELY = frozenset("nav footer aside form header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()) | LIKELY
BOXES = frozenset("html body article main section div td table blockquote figure ul ol dl details center fieldset".split()) | DROPPED | LIKELY
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a head may hold; it ends where any other begins, as its end tag is optional.
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
#: Words in class, id or role attributes that mark furniture, and words that change nothing beside one of them.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social comment comments commentlist discussion disqus reply replies respond related recommended recommendations "
    "pagination pager toolbar form search searchbox complementary contentinfo".split()
)
NEUTRAL = frozenset("site page top bottom left right list area box wrap wrapper container block inner outer section item items primary secondary global post posts entry user reader links link bar text message panel slot unit buttons tools thread form".split())
SMOOTH = (math.exp(-2.0), math.exp(-0.5), 1.0, math.exp(-0.5), math.exp(-2.0))
KEEP, DROP, LIKELY_OUT, PERHAPS_OUT = range(4)
MOST_OF_PAGE, MOST_OF_REGION = 0.5, 0.8


class _Lines(HTMLParser):
    """Boxes of a page (tag, parent, verdict; parents come before children) and its lines.

    A line: box, text, tags since the line before, characters in links, whether it is a heading, and whether an h1.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.up, self.verdict, self.in_article, self.dropped = [""], [-1], [KEEP], [False], [False]
        self.box = 0
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[int, str, int, int, bool, bool]] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0
        self.heading = self.title = False

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.dropped[self.box]:
                self.lines.append((self.box, text, self.tags, min(self.linked, len(text)), self.heading, self.title))
            self.parts = []
        self.tags, self.linked, self.heading, self.title = 0, 0, False, False

    def leave(self) -> None:
        self.open[self.tag[self.box]] -= 1
        self.box = self.up[self.box]

    def handle_starttag(self, tag, attrs):
        if self.tag[self.box] == "head" and tag not in IN_HEAD:
            self.end_line()
            self.leave()
        if tag in BLOCK or tag in DROPPED:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in HEADINGS:
            self.heading, self.title = True, tag == "h1"
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        verdict = self.judge(tag, attrs)
        if verdict != KEEP and tag not in BOXES:
            self.end_line()
        if verdict != KEEP or tag in BOXES:
            self.tag.append(tag)
            self.up.append(self.box)
            self.verdict.append(verdict)
            self.in_article.append(self.in_article[self.box] or tag in ("article", "main"))
            self.dropped.append(self.dropped[self.box] or verdict == DROP)
            self.box = len(self.tag) - 1
            self.open[tag] += 1

    def judge(self, tag: str, attrs) -> int:
        if tag in DROPPED:
            return DROP
        verdict = KEEP if tag not in LIKELY or tag == "header" and self.in_article[self.box] else LIKELY_OUT
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return DROP
            if key in ("class", "id", "role") and value and tag not in ("html", "body", "main"):
                for token in value.lower().split():
                    words = [w for w in re.split(r"[^a-z]+", token) if w]
                    found = FURNITURE.intersection(words)
                    if self.in_article[self.box] and tag != "article":
                        found -= {"header", "banner", "masthead"}
                    if found and verdict != LIKELY_OUT:
                        verdict = LIKELY_OUT if all(w in FURNITURE or w in NEUTRAL for w in words) else PERHAPS_OUT
        return verdict

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in DROPPED:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag]:
            self.end_line()
            while self.tag[self.box] != tag:
                self.leave()
            self.leave()

    def handle_data(self, data):
        if self.tag[self.box] == "head" and data.strip():
            self.leave()
        self.parts.append(data)
        if self.links:
            self.linked += len(" ".join(data.split()))


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian of radius two over a list."""
    n = len(ratios)
    out = []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(SMOOTH, i - 2):
            if 0 <= k < n:
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def marked(lines: list[tuple]) -> list[bool]:
    """Which lines are running text."""
    ratios = smoothed([(len(text) - linked) / max(1, tags) for _, text, tags, linked, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    return [r >= threshold for r in ratios]


def _summed(values: list[float], up: list[int]) -> list[float]:
    """Each box's own value and those of all boxes within it."""
    out = list(values)
    for b in range(len(out) - 1, 0, -1):
        out[up[b]] += out[b]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    lines, up, tag = page.lines, page.up, page.tag
    if not lines:
        return ""
    marks = marked(lines)
    n = len(tag)

    def sums(some: list[bool]) -> list[float]:
        own = [0.0] * n
        for (box, text, *_), good in zip(lines, some, strict=True):
            if good:
                own[box] += len(text)
        return _summed(own, up)

    mass, text_mass = sums(marks), sums([True] * len(lines))
    titles = sums([line[5] for line in lines])
    articles = sums([page.in_article[line[0]] for line in lines])
    # furniture: by tag or class, unless the marked text says otherwise; where there is an article, what is beside it has no say
    out = [False] * n
    for b in range(1, n):
        kind = page.verdict[b]
        likely = kind == LIKELY_OUT and (mass[b] < MOST_OF_PAGE * mass[0] or articles[b] < MOST_OF_PAGE * articles[0])
        perhaps = kind == PERHAPS_OUT and mass[b] < 0.5 * text_mass[b] and not titles[b]
        out[b] = out[up[b]] or likely or perhaps
    good = [m and not out[line[0]] for line, m in zip(lines, marks, strict=True)]
    mass = sums(good)
    depth = [0] * n
    for b in range(1, n):
        depth[b] = depth[up[b]] + 1
    region = 0
    for tags, share in ((("article",), MOST_OF_PAGE), (("main",), MOST_OF_PAGE), (("div", "section", "td"), MOST_OF_REGION)):
        if mass[0] and (fit := [b for b in range(1, n) if tag[b] in tags and not out[b] and mass[b] >= share * mass[0]]):
            region = max(fit, key=lambda b: (depth[b], mass[b]))
            break
    whole = tag[region] in ("article", "main")
    if not whole and region:
        heads = sums([line[5] and not out[line[0]] for line in lines])
        own = {line[0] for line, m in zip(lines, good, strict=True) if m and 2 * line[3] <= len(line[1])}
        at = region
        while at:  # a title beside the region belongs to it, and so does running text right in a box around it
            at = up[at]
            if heads[at] > heads[region] or at in own:
                region = at
    inside = [False] * n
    inside[region] = True
    for b in range(region + 1, n):
        inside[b] = inside[up[b]]
    kept = [i for i, line in enumerate(lines) if inside[line[0]] and not out[line[0]]]
    if not whole:
        kept = _clusters(kept, lines, good)
    return "\n\n".join(lines[i][1] for i in kept)


def _clusters(kept: list[int], lines: list[tuple], good: list[bool]) -> list[int]:
    """Lines of a region that its clusters of marked lines select."""
    text = {i for i in kept if 2 * lines[i][3] <= len(lines[i][1])}  # the smoothing marks links beside running text too
    at = [i for i in kept if good[i] and i in text]
    if not at:
        return kept
    first, last, homes = at[0], at[-1], {lines[i][0] for i in at}
    out = []
    for i in kept:
        box, _, _, _, heading, _ = lines[i]
        if good[i] and i in text or box in homes or heading and i < last or first < i < last and i in text:
            out.append(i)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_html in batches:
            yield pd.Series([main_text(h) if isinstance(h, str) else "" for h in pages_html], dtype=object)

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), to_text(F.col(html_col)).alias("text"))
    return slim.withColumn("n_chars", F.length("text").cast("long"))
