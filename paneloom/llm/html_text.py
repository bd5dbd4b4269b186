"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams a page's events. They become lines: a line is the text between two block tags,
with the number of tags since the line before. Lines inside elements that are never part of an article (scripts, menus,
forms, ...; by tag) are left out. So are those inside an element that a class, id or role names as such, unless it holds
most of the text of the article or page around it, or an article, main or h1 element. The ratio of text to tags of the
other lines is smoothed with a Gaussian, and lines at or above the standard deviation of the smoothed ratios are content.
Neighbouring content lines are a cluster, and a cluster grows to the lowest container (article, main, section, div, td) around
it, to lines beside it that reach a lower cut, and to the headings directly before it; no tag name decides. Every content
line is kept, and all between the first and the last, but not lines at either end that are mostly links and reach the cut
only by their neighbours.

White space inside a line becomes one space, lines are trimmed, empty ones go, and the others are joined by one \\n in
page order. Nothing else is dropped, and no length is capped. Null and empty pages have an empty text; text without tags
is a single line; unclosed elements end with their parents. Repeated rows each get a row, an empty table gives an empty
result, and other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import small_batches

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: Part of the cut that a line beside a region must reach to be taken in.
LOWER = 0.5

#: Elements that are no part of an article.
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form frameset head header iframe input label legend menu "
    "nav noframes noscript object optgroup option script search select style svg template textarea title video".split()
)
#: Words in class, id or role that say the same; a plural s is ignored.
HINTS = frozenset(
    "ad adbox adslot adsense advert advertisement advertising alert banner breadcrumb byline comment commentlist complementary "
    "consent contentinfo cookie copyright dialog discussion disqus feedback footer form gdpr header hint legal login "
    "masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination paywall popup "
    "promo promotion recommended related reply respond search share sidebar sidenav signup skip social sponsor sponsored "
    "subscribe taboola toolbar topbar warning widget".split()
)

#: Words that turn the hint at a token's end around.
NEGATIONS = frozenset("has have hide hides no non not show shows with without".split())

#: An end tag that a new block of the same kind implies.
CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"),
          "tr": ("tr",), "option": ("option",)}
#: Elements out of which an implied end tag does not reach.
WALLS = CONTAINERS | frozenset("aside footer header nav form table ul ol dl blockquote".split())


def hinted(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a token of class, id or role is a hint, or ends with one that no word before it negates."""
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value or "").lower().split():
                words = re.findall(r"[a-z0-9]+", token)
                if words and (known("".join(words)) or known(words[-1]) and NEGATIONS.isdisjoint(words)):
                    return True
    return False


def known(word: str) -> bool:
    return word in HINTS or word.removesuffix("s") in HINTS


def unseen(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


class Lines(HTMLParser):
    """Collects lines (text, tags, container) and the containers that span them.

    Text inside hinted elements is kept apart by element until ``finish`` knows how much each of them holds.
    """

    def __init__(self, most: float) -> None:
        super().__init__(convert_charrefs=True)
        self.most = most
        self.lines: list[tuple[str, int, int]] = []  # text, tags, container
        self.links: list[int] = []  # characters of each line that are in links
        self.headings: list[bool] = []  # whether each line is a heading
        self.raw: list[tuple[list[tuple[str, int, bool]], int, int, bool]] = []  # lines as parts, tags, container, heading
        self.nodes: list[list] = [["", -1, 0, None]]  # tag, parent, first line, line after the last
        self.hints: list[list] = [[-1, 0, False]]  # parent, scope, whether it is kept for what it holds
        self.scopes = [0]  # characters of text on the page and in each article or main element
        self.sizes = [0]  # characters of text in each hinted element
        self.stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, 0, 0)]  # tag, left out, container, hint, scope
        self.open: Counter[str] = Counter()
        self.parts: list[tuple[str, int, bool]] = []  # text, hinted element, whether it is in a link
        self.tags = 0
        self.around: list[int] = [-1]  # scope around each scope

    def flush(self) -> None:
        parts, self.parts = self.parts, []
        if any(text.strip() for text, _, _ in parts):
            self.raw.append((parts, self.tags, self.stack[-1][2], any(self.open[h] for h in HEADINGS)))
            self.tags = 0

    def push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, out, node, hint, scope = self.stack[-1]
        if tag in CONTAINERS:
            self.nodes.append([tag, node, len(self.raw), None])
            node = len(self.nodes) - 1
        root = tag in ("html", "body")
        out = out or tag in BOILERPLATE or not root and tag not in ARTICLES and unseen(attrs)
        # An article with a hint inside an article is a comment, say.
        doubted = not root and (tag not in ARTICLES or tag == "article" and self.open["article"]) and hinted(attrs)
        if not out:
            if tag == "h1" or tag in ARTICLES and not doubted:
                at = hint
                while at and not self.hints[at][2]:
                    self.hints[at][2] = True
                    at = self.hints[at][0]
            if doubted:
                self.hints.append([hint, scope, tag == "h1"])
                self.sizes.append(0)
                hint = len(self.hints) - 1
            elif tag in ARTICLES:
                self.scopes.append(0)
                self.around.append(scope)
                scope = len(self.scopes) - 1
        self.stack.append((tag, out, node, hint, scope))
        self.open[tag] += 1

    def pop(self) -> None:
        tag, _, node, _, _ = self.stack.pop()
        self.open[tag] -= 1
        if tag in CONTAINERS:
            self.nodes[node][3] = len(self.raw)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.handle_text(" ")
        if tag in BLOCKS and tag not in ("html", "body"):
            self.imply(CLOSES.get(tag, ("p",)))
        if tag not in VOID:
            self.push(tag, attrs)

    def imply(self, closed: tuple[str, ...]) -> None:
        """End the nearest element of ``closed`` unless a wall stands before it."""
        if not any(self.open[t] for t in closed):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at][0]
            if tag in closed:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in WALLS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.handle_text(" ")
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.handle_text(data)

    def handle_text(self, data: str) -> None:
        _, _, _, hint, scope = self.stack[-1]
        self.parts.append((data, hint, self.open["a"] > 0))
        size = sum(map(len, data.split()))
        self.sizes[hint] += size
        self.scopes[scope] += size

    def finish(self) -> None:
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        self.nodes[0][3] = len(self.raw)
        # Children come after their parents.
        for at in range(len(self.sizes) - 1, 0, -1):
            self.sizes[self.hints[at][0]] += self.sizes[at]
        for at in range(len(self.scopes) - 1, 0, -1):
            self.scopes[self.around[at]] += self.scopes[at]
        left_out = [False]
        for (parent, scope, kept), size in zip(self.hints[1:], self.sizes[1:]):
            left_out.append(left_out[parent] or not kept and size < self.most * self.scopes[scope])
        places, tags = [], 0
        for parts, more, node, heading in self.raw:
            places.append(len(self.lines))
            tags += more
            shown = [(data, link) for data, hint, link in parts if not left_out[hint]]
            text = " ".join("".join(data for data, _ in shown).split())
            if text:
                self.links.append(sum(len("".join(data.split())) for data, link in shown if link))
                self.lines.append((text, tags, node))
                self.headings.append(heading)
                tags = 0
        places.append(len(self.lines))
        for node in self.nodes:
            node[2:] = places[node[2]], places[node[3]]


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a window of two sigmas to each side; weights beyond the ends are shared by the rest."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def clustered(lines: list[tuple[str, int, int]]) -> tuple[list[float], float]:
    """Smoothed text-to-tag ratios, and their standard deviation (at most their greatest) as the cut."""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return ratios, min(spread, max(ratios))


def content_lines(lines: list[tuple[str, int, int]]) -> list[int]:
    """Numbers of the lines whose smoothed text-to-tag ratio reaches the standard deviation of all."""
    ratios, cut = clustered(lines)
    return [i for i, r in enumerate(ratios) if r >= cut]


def without_menus(page: Lines, content: list[int]) -> list[int]:
    """Content lines but for those that are mostly links and that only their neighbours lift above the cut."""
    _, cut = clustered(page.lines)
    return [
        i for i in content
        if 2 * page.links[i] <= len(page.lines[i][0]) or len(page.lines[i][0]) / max(1, page.lines[i][1]) >= cut
    ] or content


def container_of(nodes: list[list], lines: list[tuple[str, int, int]], run: list[int]) -> int:
    """The lowest container around a run of lines."""
    around = lines[run[0]][2]
    for i in run[1:]:
        other = lines[i][2]
        while around != other:  # parents have lower numbers than their children
            around, other = (nodes[around][1], other) if around > other else (around, nodes[other][1])
    return around


def regions(page: Lines, content: list[int]) -> tuple[int, int]:
    """The first line of the main text and the line after its last one.

    A run of neighbouring content lines is a cluster. It grows to the whole of the lowest container around it, unless that
    is the page itself; then to lines beside it that reach the lower cut, and to the headings directly before it.
    """
    lines, nodes = page.lines, page.nodes
    runs: list[list[int]] = []
    for i in content:
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    ratios, cut = clustered(lines)
    first, last = content[0], content[-1] + 1
    for run in runs:
        tag, _, begin, end = nodes[container_of(nodes, lines, run)]
        if tag not in ("", "body"):
            first, last = min(first, begin), max(last, end)

    def near(i: int) -> bool:
        return ratios[i] >= LOWER * cut and 2 * page.links[i] <= len(lines[i][0])

    while first and (page.headings[first - 1] or near(first - 1)):
        first -= 1
    while last < len(lines) and near(last) and not page.headings[last]:
        last += 1
    return first, last


def main_text(html: str | None, *, most: float = 0.6) -> str:
    """The main text of one page; a hinted element with the share ``most`` of the text around it is not left out."""
    page = Lines(most)
    page.feed(html or "")
    page.finish()
    if not page.lines:
        return ""
    first, last = regions(page, without_menus(page, content_lines(page.lines)))
    return "\n".join(text for text, _, _ in page.lines[first:last])


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, without any shuffle."""
    small_batches(pages.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    done = rows.mapInArrow(scan, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
