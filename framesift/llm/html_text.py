"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser feeds events as they come. Block elements end a line; a line keeps its text, the tags met in it
and the container that it stands in. What HTML itself says to be no text of the page (scripts, styles, templates, controls, hidden
elements) makes no line; what it says to stand beside the content (navigation, headers, footers, asides, forms, or such a role)
makes lines that count for the ratios but are never kept. No names of classes or ids are looked at.

The text-to-tag ratios of the lines, in page order, are smoothed with a Gaussian. A threshold found by two-means on their logarithms
splits them in two clusters. A container is a content region if its own ratio, all its text by all its tags, and the smoothed ratio
of one of its lines lie in the upper cluster, or if none has more text; all its lines are kept then, short ones too. A mark of the
content by `article` or `main`, as HTML defines them, is evidence: it counts as MARKED in the logarithm of each ratio in it, before
the threshold is found. Text outside it stays if its ratio is that much higher. In it, where all but menus is content, a container
goes only if its ratio lies below the threshold without marks and below SPARSE.

Null html, or no content: empty text. Broken markup is read as far as the parser goes; an element left open ends with its
page. Repeated rows: a row each. Null page_id or url: kept null. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: No text of the page, by HTML: nothing in them is a line.
SILENT = set("audio button canvas datalist head iframe input noscript object option script select style svg template textarea title video".split())
#: Beside the content, by HTML or ARIA.
BESIDE = set("aside dialog footer form header menu nav search".split())
BESIDE_ROLE = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status note".split())
CONTAINER = set("article blockquote body div figure main section td".split())
#: In `article` and `main`, where quotes, figures and cells are content of what they stand in.
INNER = set("article div main section".split())
MARK = set("article main".split())
#: What `article` and `main` add to the logarithm of a ratio: as much as 55 times the text for each tag.
MARKED = 4.0
#: Logarithm of the text for each tag, 5, below which a container in `article` or `main` is a menu in it.
SPARSE = float(np.log(5))
TAG_START = set("/!?abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an element does to its text, the strongest of it and its ancestors: 0 nothing, 1 beside the content, 2 silent.
PLAIN, ASIDE, MUTE = 0, 1, 2


def effect(tag: str, attrs: list[tuple[str, str | None]], marked: bool) -> int:
    """A header in article or main belongs to the content."""
    if tag in SILENT:
        return MUTE
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or ""):
            return MUTE
        if name == "role" and (value or "").lower() in BESIDE_ROLE:
            return ASIDE
    return ASIDE if tag in BESIDE and not (tag == "header" and marked) else PLAIN


class Lines(HTMLParser):
    """lines: (text, tags, container, beside the content, in article or main) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, effect, container, in article or main
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.text: list[str] = []
        self.tags, self.containers = 0, 0

    def _end_line(self) -> None:
        if self.text:
            s = SPACE.sub(" ", "".join(self.text)).strip()
            if s:
                _, out, container, marked = self.stack[-1] if self.stack else ("", PLAIN, 0, False)
                self.lines.append((s, self.tags, container, out == ASIDE, marked))
                self.tags = 0
            self.text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
            if tag in ("p", "li", "tr", "td", "dt", "dd", "option"):
                self._close_same(tag)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            self.tags += 1
            return
        _, out, container, marked = self.stack[-1] if self.stack else ("", PLAIN, 0, False)
        mine = effect(tag, attrs, marked)
        self.tags += max(out, mine) != MUTE
        marked = marked or tag in MARK
        if tag in (INNER if marked else CONTAINER) or mine > out:
            self.containers += 1
            container = self.containers
        self.stack.append((tag, max(out, mine), container, marked))

    def _close_same(self, tag: str) -> None:
        """An element of this kind that is open since the nearest container ends here."""
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0]
            if t == tag:
                del self.stack[i:]
                return
            if t in BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.stack or self.stack[-1][1] != MUTE
        if tag in BLOCK:
            self._end_line()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1][1] != MUTE:
            self.text.append(data)

    def done(self) -> list[tuple[str, int, int, bool, bool]]:
        self.close()
        self._end_line()
        return self.lines


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray, apart: float = 0.7) -> float:
    """Middle of the two means of the logarithms of ratios; the least value where the means are less than `apart` from each other."""
    lo, hi = float(values.min()), float(values.max())
    least = lo
    for _ in range(20):
        mid = (lo + hi) / 2
        a, b = values[values < mid], values[values >= mid]
        if not len(a) or not len(b):
            return least
        lo, hi = float(a.mean()), float(b.mean())
    return (lo + hi) / 2 if hi - lo >= apart else least


def regions(lines: list[tuple[str, int, int, bool, bool]]) -> set[int]:
    """The containers whose lines are content."""
    size, tags = np.array([len(x[0]) for x in lines], float), np.array([max(1, x[1]) for x in lines], float)
    names, of = np.unique([x[2] for x in lines], return_inverse=True)
    beside, mark = np.array([x[3] for x in lines], bool), np.array([x[4] for x in lines], bool)
    content, marked = np.zeros((2, len(names)), bool)
    content[of[~beside]], marked[of[mark]] = True, True
    own = np.log(np.bincount(of, size) / np.bincount(of, tags))
    line = np.log(smooth(size / tags))
    least = threshold(line + MARKED * mark)
    top = np.full(len(names), -np.inf)
    np.maximum.at(top, of, line)
    kept = content & np.where(marked, own >= min(threshold(line), SPARSE), (own >= least) & (top >= least))
    most = content & marked if (content & marked).any() else content
    if most.any():  # the one with the most text is content, whatever the clusters are
        kept[np.where(most, np.bincount(of, size), -1).argmax()] = True
    return set(names[kept].tolist())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    last = html.rfind("<")
    if last > html.rfind(">") and html[last + 1 : last + 2] in TAG_START:
        html = html[:last]  # a tag cut off by the end of the page
    parser = Lines()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    content = regions(lines)
    return "\n".join(t for t, _, c, beside, _ in lines if c in content and not beside)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; pages are parsed where they are read."""

    def run(it):
        for b in batches(it):
            texts = [main_text(h) for h in b["html"]]
            yield pa.RecordBatch.from_pydict(
                {"page_id": pa.array(b["page_id"], pa.int64()), "url": pa.array(b["url"], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
