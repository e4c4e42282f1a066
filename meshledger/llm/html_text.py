"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams over a page. Block elements end a line; each line knows its
text, its number of tags and the element that holds it. Text of elements that never are content
(scripts, buttons and the like) is not collected. Menus, forms, and elements one of whose class names
or whose id is that of an advert, a sidebar, comments and the like are marked; when the page is known,
the marks are lifted from elements that turn out to be wrappers of the content (`_marked`), and lines
of elements still marked are left out. The text-to-tag ratio of the lines is smoothed with a Gaussian and lines above the
standard deviation are the content cluster. The region is the innermost article or main element that
holds most of that cluster, with all its lines, however short; several top articles that hold about as
much as each other are one region. A page without such an element gives the lines from the first to the last of the cluster inside the innermost element that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGMA, RADIUS, SHARE = 1.0, 2, 0.5

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video "
                  "button select textarea input title head".split())
ARTICLE = frozenset(("article", "main"))
#: What may stand in a head and in a select; any other block ends one whose end tag is left out.
IN_HEAD = frozenset("base link meta noscript script style template title head".split())
IN_SELECT = frozenset("option optgroup hr script template select".split())
#: Opening one of these ends an open element of the listed names, as their end tags may be left out.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: How sure a mark is: LOOSE ones may sit on a wrapper, NAMED and TAGGED ones hardly ever do.
LOOSE, NAMED, TAGGED = 1, 2, 3
MARKED_TAGS = {"form": LOOSE, "aside": LOOSE, "dialog": LOOSE, "nav": TAGGED, "footer": TAGGED, "menu": TAGGED}
MARKED_ROLES = {"complementary": LOOSE, "search": LOOSE, "form": LOOSE, "dialog": LOOSE, "alertdialog": LOOSE, "alert": NAMED,
                "navigation": TAGGED, "banner": TAGGED, "contentinfo": TAGGED, "menu": TAGGED, "menubar": TAGGED}
_SIDE = r"(?:(?:site|main|page|top|bottom|left|right|primary|secondary|global|mobile|post|article|entry|user|google)[_-]+)?"
_PART = r"(?:[_-]+(?:list|area|section|box|bar|block|panel|slot|unit|links?|items?|buttons?|icons?|form|text|title|thread|count|message|body|wrap(?:per)?|meta|author))?"
#: Whole class names and ids: a listed word alone, or in a compound of a place before or a part behind.
NAMES = {
    NAMED: re.compile(
        _SIDE + r"(?:ads?|advert(?:isement|s)?|cookies?|consent|gdpr|comments?|disqus|replies|respond|nav|navbar|navigation|menu|"
        r"breadcrumbs?|footer)" + _PART + r"|adsbygoogle|ads?[_-]+(?:container|wrapper|banner)|(?:cookies?|gdpr|consent)[_-]+(?:notice|banner|popup|consent)|"
        r"(?:site|top)[_-]?header|masthead", re.I),
    LOOSE: re.compile(
        _SIDE + r"(?:sponsor(?:ed)?|promo(?:tion)?|banner|notices?|popup|modal|overlay|newsletter|subscribe|signup|sidebar|aside|widget|"
        r"share|sharing|social|related|recommended|login)" + _PART + r"|(?:social|share)[_-]+(?:media|share|sharing)|newsletter[_-]+signup|"
        r"(?:related|recommended)[_-]+(?:posts?|articles?|stories|content|products)|sidebar[_-]+widget", re.I),
}


class PageLines(HTMLParser):
    """Lines of a page: (text, tags, element, heading), and the parent, name and mark of every block element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parents, self.names, self.marks = [-1], ["#page"], [0]
        self.stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
        self.text: list[str] = []
        self.tags, self.heading = 0, False

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1], self.heading))
            self.tags = 0
        self.text, self.heading = [], False

    def _mark(self, tag: str, attrs: list) -> int:
        nested = tag == "article" and any(name == "article" for name, _, _ in self.stack)  # such as a reader's comment
        if tag in ARTICLE and not nested or tag in ("body", "html"):
            return 0
        found = dict(attrs)
        marks = [MARKED_TAGS.get(tag, 0), MARKED_ROLES.get((found.get("role") or "").lower(), 0)]
        if tag == "header" and not any(name in ARTICLE for name, _, _ in self.stack):
            marks.append(TAGGED)
        if "hidden" in found or found.get("aria-hidden") == "true":
            marks.append(LOOSE)
        if tag != "h1":
            names = [*(found.get("class") or "").split(), (found.get("id") or "").strip()]
            marks += [sure for sure, known in NAMES.items() if any(map(known.fullmatch, names))]
        return max(marks)

    def _close(self, at: int) -> None:
        self._end_line()
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in VOID:
            for at in range(len(self.stack) - 1, 0, -1):
                name = self.stack[at][0]
                if name == "head" and tag not in IN_HEAD or name == "select" and tag not in IN_SELECT:
                    self._close(at)
                    break
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag == "br":
                self.text.append(" ")
            return
        mark = self._mark(tag, attrs)
        if tag in INLINE and not mark:
            return
        self._end_line()
        if tag not in INLINE:
            for at in range(len(self.stack) - 1, 0, -1):
                name = self.stack[at][0]
                if name == "p" or name in ENDS.get(tag, ()):
                    self._close(at)
                    break
                if name not in INLINE and name not in ("td", "th", "dd", "dt"):
                    break
        self.parents.append(self.stack[-1][1])
        self.names.append(tag)
        self.marks.append(mark)
        self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        self.stack.append((tag, len(self.parents) - 1, tag in NEVER or self.stack[-1][2]))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE and all(name != tag for name, _, _ in self.stack):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if self.stack[at][0] in ARTICLE and tag not in ("body", "html", "article", "main"):
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.text.append(data)


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA * SIGMA))
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[RADIUS:RADIUS + len(ratios)]


Lines = list[tuple[str, int, int, bool]]


def _cluster(lines: Lines) -> np.ndarray:
    """Which lines are in the content cluster."""
    smooth = _smoothed(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    return smooth >= min(smooth.std(), smooth.max())


def _held(page: PageLines, lines: Lines, which: np.ndarray) -> np.ndarray:
    """Characters of the chosen lines inside each element."""
    held = np.zeros(len(page.parents))
    for (text, _, owner, _), chosen in zip(lines, which):
        held[owner] += len(text) * bool(chosen)
    for child in range(len(held) - 1, 0, -1):  # children come after their parents
        held[page.parents[child]] += held[child]
    return held


def _below(page: PageLines, chosen: np.ndarray) -> np.ndarray:
    """Elements that are chosen or lie in one that is."""
    out = chosen.copy()
    for k in range(1, len(out)):
        out[k] |= out[page.parents[k]]
    return out


def _marked(page: PageLines) -> tuple[np.ndarray, list[int]]:
    """Elements whose lines are left out, and elements without an article whose mark was lifted.

    A mark is lifted from an element around an article or main element, if no other one stands
    outside all marks, and from a LOOSE one that holds most of the content cluster, if it has an
    article or is inside one, or the page has none outside all marks. A page that would be left
    without text gives up the marks of NAMED elements that hold most of it.
    """
    marks = np.array(page.marks)
    if not marks.any() or not page.lines:
        return marks > 0, []
    held = _held(page, page.lines, _cluster(page.lines))
    most = held >= SHARE * held[0]
    path = _below(page, marks > 0)
    plain = _held(page, page.lines, np.array([not path[owner] for _, _, owner, _ in page.lines]))
    text = _held(page, page.lines, np.ones(len(page.lines), bool))
    article = np.array([name in ARTICLE for name in page.names])
    inside = _below(page, article)
    anchored = bool((article & (plain > 0)).any())
    around, around_most = article & (text > 0), article & (text > 0) & most
    for k in range(len(marks) - 1, 0, -1):
        around[page.parents[k]] |= around[k]
        around_most[page.parents[k]] |= around_most[k]
    left, bare = marks > 0, []
    for k in np.flatnonzero(left).tolist():
        loose = marks[k] == LOOSE
        wraps = not anchored and (around[k] if loose else around_most[k])
        if wraps or loose and most[k] and (around[k] or inside[k] or not anchored):
            left[k] = False
            if not around[k] and not inside[k]:
                bare.append(k)
    if all(_below(page, left)[owner] for _, _, owner, _ in page.lines):
        left &= ~((marks == NAMED) & most)
    return left, bare


def _equal_articles(page: PageLines, held: np.ndarray) -> list[int]:
    """Articles in no other article that hold at least SHARE of what the fullest of them holds."""
    article = np.array([name == "article" for name in page.names])
    below = np.zeros(len(held), bool)
    for k in range(1, len(held)):
        up = page.parents[k]
        below[k] = below[up] or article[up]
    tops = [k for k in np.flatnonzero(article & ~below).tolist() if held[k] > 0]
    return [k for k in tops if held[k] >= SHARE * max(held[t] for t in tops)]


def main_text(html: str | None) -> str:
    """The main text, blocks joined by line feeds; empty for null, empty or text-free pages.

    A head or select whose end tag is left out ends at the next block that cannot stand in it. An
    article inside an article is left out if its names are those of a comment or the like.
    """
    page = PageLines()
    page.feed(html or "")
    page.close()
    page._end_line()
    left, bare = _marked(page)
    left = _below(page, left)
    lines, tags = [], 0
    for line in page.lines:  # the tags of lines left out count with the next line
        tags += line[1]
        if not left[line[2]]:
            lines.append((line[0], tags, *line[2:]))
            tags = 0
    if not lines:
        return ""
    content = _cluster(lines)
    held = _held(page, lines, content)
    most = [k for k in range(len(held)) if held[k] >= SHARE * held[0]]
    articles = [k for k in most if page.names[k] in ARTICLE]
    # what was taken for noise does not push out text beside it
    part = np.zeros(len(held), bool)
    part[[k for k in bare if held[k] < held[0]]] = True
    part = _below(page, part)
    region = max(articles or [k for k in most if not part[k] and page.names[k] not in ("p", "li", "td", "pre", "blockquote")] or [0])
    inside = np.zeros(len(page.parents), bool)
    equal = _equal_articles(page, held)
    if len(equal) > 1 and sum(held[k] for k in equal) >= SHARE * held[0]:
        articles = equal
        inside[equal] = True
    else:
        inside[region] = True
    inside = _below(page, inside)
    kept = np.array([inside[owner] for _, _, owner, _ in lines])
    if not articles:
        at = np.flatnonzero(content & kept)
        first = int(at[0])
        while first and lines[first - 1][3] and kept[first - 1]:
            first -= 1
        kept[:first], kept[at[-1] + 1:] = False, False
    return "\n".join(line[0] for line, keep in zip(lines, kept) if keep)


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column(batch.num_columns - 1)
        for row in range(0, len(html), 256):
            found = [main_text(page.as_py()) for page in html.slice(row, 256)]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(row, 256) for c in batch.columns[:-1]), pa.array(found, pa.string())], [*batch.schema.names[:-1], "text"])


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every row; rows are independent, so repeats get equal texts."""
    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string"])
    return pages.select(*keep, F.col(html_col).cast("string").alias("html")).mapInArrow(_work, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
