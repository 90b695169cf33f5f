"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed a page piece by piece; its events are
gathered into *lines*, one per block element.  A line's ratio is its text
length by its number of tags (link text does not count).  The ratios are
smoothed by a Gaussian over neighbouring lines and split by a threshold, their
standard deviation, into content and the rest.  The ``article`` and ``main``
elements with content are the article, or else the deepest container that
holds ``HOLD`` of the content.  All its lines belong to the main text, short
ones included, but for furniture: navigation, page headers,
footers, sidebars, notices, adverts, forms, hidden parts and reader comments,
recognised by element, role, class or id.

A name can mislead: a page may sit in a form, or in a container that is called
after the sidebar beside it.  So furniture by name, role, ``form`` or ``header``
is decided after the page is read: a container that holds most of the page's
text is none (``holds_the_page``).  The names of ``html`` and ``body`` mean
nothing, and those of ``article`` and ``main`` only if they say that it is a
comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import Emitter, row_stream

#: Characters fed to the parser at a time.
FEED = 1 << 16
#: Reach and spread of the Gaussian, in lines.
REACH, SIGMA = 2, 1.0
#: Share of link text from which a line outside paragraphs, headings and
#: ``article`` or ``main`` is a menu entry, if another one is beside it.
LINK_SHARE = 0.8
#: Share of the content that a container must hold to be the article.
HOLD = 0.9
#: Lines that such a container has at least, if it has no article and no title.
HELD_LINES = 3
#: Words from which a paragraph in an article's header is its standfirst.
STANDFIRST = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Blocks that are parts of a text, never the container of an article.
PARTS = frozenset(
    "address blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup html legend li ol p "
    "pre summary table tbody td tfoot th thead tr ul".split()
)
# Blocks whose lines are no menu entries, even if they are links.
UNLISTED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# Elements whose text is never part of an article.
SKIPPED = frozenset(
    "applet aside audio canvas datalist dialog footer head iframe input map menu nav noembed noframes "
    "noscript object option script select style svg template textarea title video".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split()
)
# Names of furniture, as the last word of a class or id.
FURNITURE = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs byline captcha comment comments consent "
    "cookie cookies disclaimer disqus footer form gdpr hidden login masthead menu meta modal nav navbar navigation "
    "navigationbar newsletter notice notices overlay pager pagination paywall popup promo promotion promotions recommended "
    "related replies respond search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar widget widgets".split()
)
# ... and as its first word.
LEADING = frozenset(
    "ad ads adsense advert advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus gdpr menu nav navbar "
    "navigation newsletter popup promo related share sidebar social sponsor sponsored subscribe".split()
)
# Elements whose text is a part of a sentence, or else a control by itself.
CONTROLS = frozenset({"button", "label"})
COMMENTS = frozenset("comment comments disqus replies respond".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADERS = frozenset({"header", "topbar", "top-bar", "page-header", "site-header"})
NEUTRAL = frozenset({"has", "no", "with", "without"})
# A start tag of these closes an open one of the set.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
_SPACE = re.compile(r"\s+")
_OPEN_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# What an element is: part of the page, a header or furniture if it does not
# hold the page, comments, or furniture in any case.
PART, HEADER, SOFT, COMMENT, HARD = range(5)


def _by_name(name: str, tag: str) -> int:
    """What a class or an id says of an element."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    if not words:
        return PART
    if tag in ("article", "main"):
        return COMMENT if words[-1] in ("comment", "comments") else PART
    before = next((k for k, w in enumerate(words) if w in NEUTRAL), len(words))
    if before < len(words) - 1:  # "content with sidebar" is no sidebar
        words = words[:before]
        if not words:
            return PART
    if name.lower() in HEADERS:
        return HEADER
    if words[-1] in FURNITURE or words[0] in LEADING:
        return COMMENT if words[-1] in COMMENTS or words[0] in COMMENTS else SOFT
    return PART


def kind_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """PART, HEADER, SOFT, COMMENT or HARD."""
    if tag in SKIPPED:
        return HARD
    if tag in ("html", "body"):
        return PART
    kind = {"form": SOFT, "header": HEADER}.get(tag, PART)
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return HARD
        if key == "role" and tag not in ("article", "main") and value.lower().strip() in ROLES:
            kind = max(kind, SOFT)
        if key in ("class", "id"):
            kind = max([kind, *(_by_name(name, tag) for name in value.split())])
    return kind


class Line:
    """Text of a block: its tags, link and control characters, and the
    numbers of the containers around it."""

    __slots__ = ("text", "tags", "links", "controls", "path")

    def __init__(self, text: str, tags: int, links: int, controls: int, path: tuple[int, ...]):
        self.text, self.tags, self.links, self.controls, self.path = text, tags, links, controls, path

    @property
    def plain(self) -> int:
        """Characters that are no link."""
        return max(0, len(self.text) - self.links)


class Lines(HTMLParser):
    """Collects the lines of a page and what each container is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tag: list[str] = []  # of each container number
        self.kind: list[int] = []
        self.open: list[tuple[str, int]] = []
        self.in_link = False
        self.in_controls = 0
        self.text: list[str] = []
        self.tags = self.links = self.controls = 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.links, self.controls, tuple(n for _, n in self.open)))
            self.tags = 0
        self.text, self.links, self.controls = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            self.tags += 1
            return
        if tag in BLOCKS:
            self.end_line()
            # A link that is not closed ends at the next block.
            self.in_link, self.in_controls = False, 0
            if tag == "body":
                self.open = [x for x in self.open if x[0] == "html"]  # an unclosed head ends here
            for other in CLOSES.get(tag, {"p"}):
                if self.open and self.open[-1][0] == other:
                    self.close_to(len(self.open) - 1)
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.in_link = True
        if tag in CONTROLS:
            self.in_controls += 1
        kind = kind_of(tag, attrs)
        if tag in BLOCKS or kind != PART:
            self.open.append((tag, len(self.tag)))
            self.tag.append(tag)
            self.kind.append(kind)

    def close_to(self, k: int) -> None:
        if any(tag in BLOCKS for tag, _ in self.open[k:]):
            self.end_line()
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in CONTROLS:
            self.in_controls = max(0, self.in_controls - 1)
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                break
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] not in BLOCKS:
            return  # furniture inside a line, which goes on behind it
        self.text.append(data)
        size = len(data.strip())
        if self.in_link:
            self.links += size
        if self.in_controls:
            self.controls += size


def holds_the_page(page: Lines) -> set[int]:
    """Containers that are furniture by name but hold the page's text: half
    of it with a title, an article or a main element, or nearly all of it in
    several lines.  Comments count as text only if there is no other, and hold
    the page only with a first title or a main element in them."""
    kinds, tags = page.kind, page.tag
    plain = [x for x in page.lines if x.plain and not any(kinds[n] == HARD for n in x.path)]
    others = [x for x in plain if not any(kinds[n] == COMMENT for n in x.path)]
    total = sum(x.plain for x in others or plain)
    held: dict[int, int] = {}
    lines: dict[int, int] = {}
    marked: set[int] = set()  # with an article or a title in them
    first: set[int] = set()  # with a first title or a main element in them
    for x in plain:
        for k, n in enumerate(x.path):
            if kinds[n] == PART:
                continue
            held[n] = held.get(n, 0) + x.plain
            lines[n] = lines.get(n, 0) + 1
            inner = [m for m in x.path[k:] if kinds[m] == PART]
            if any(tags[m] in ("article", "main", "h1") for m in inner):
                marked.add(n)
            if any(tags[m] in ("main", "h1") for m in inner):
                first.add(n)
    out = set()
    for n, size in held.items():
        if kinds[n] == COMMENT and others:
            if n in first and size >= 0.5 * total:
                out.add(n)
        elif size >= 0.5 * total and n in marked or size >= HOLD * total and lines[n] >= HELD_LINES:
            out.add(n)
    return out


def furniture(page: Lines) -> list[bool]:
    """Whether each line is part of furniture.  In the header of an article,
    titles and a standfirst are not; nor is a button or a label inside a
    sentence."""
    holding = holds_the_page(page)
    out = []
    for x in page.lines:
        around = [n for n in x.path if page.kind[n] != PART and n not in holding]
        if not around:
            out.append(x.controls > 0 and x.controls >= len(x.text.replace(" ", "")))
            continue
        tags = [page.tag[n] for n in x.path]
        heads = all(page.kind[n] == HEADER and "article" in tags[: x.path.index(n)] for n in around)
        kept = tags[-1] in TITLES or tags[-1] == "p" and len(x.text.split()) >= STANDFIRST and 2 * x.plain > len(x.text)
        out.append(not (heads and kept))
    return out


def lines_of(html: str) -> Lines:
    parser = Lines()
    html = _OPEN_TAG.sub("", html)  # a tag cut off by the end of the page
    for lo in range(0, len(html), FEED):
        parser.feed(html[lo : lo + FEED])
    parser.close()
    parser.end_line()
    return parser


def smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[REACH : REACH + len(ratios)]
    return np.convolve(ratios, kernel, "full")[REACH : REACH + len(ratios)] / weight


def articles(page: Lines, content: list[bool]) -> set[int]:
    """The containers whose lines are the article; none: the whole page."""
    below: dict[int, int] = {}  # content characters below each container
    outer: dict[int, int] = {}  # the outermost article or main around each inner one
    total = 0
    for x, good in zip(page.lines, content, strict=True):
        if not good:
            continue
        total += len(x.text)
        marked = [n for n in x.path if page.tag[n] in ("article", "main")]
        outer.update((n, marked[0]) for n in marked)
        for n in x.path:
            below[n] = below.get(n, 0) + len(x.text)
    if outer:
        # Of each outermost one the innermost that has all its content.
        whole = [n for n in outer if below[n] == below[outer[n]]]
        return {max(n for n in whole if outer[n] == top) for top in set(outer.values())}
    # Containers with most of the content lie in each other.
    holding = [n for n, k in below.items() if k >= HOLD * total and page.tag[n] not in PARTS]
    return {max(holding)} if holding else set()


def main_text(html: str) -> str:
    page = lines_of(html)
    lines, skipped = page.lines, furniture(page)
    ratios = np.array([0 if off else x.plain / max(1, x.tags) for x, off in zip(lines, skipped, strict=True)], dtype=float)
    if not ratios.any():
        return ""
    smooth = smoothed(ratios)
    content = (smooth >= smooth.std()) & (ratios > 0)
    if not content.any():
        content = ratios > 0
    tops = articles(page, content.tolist())
    own = any(page.tag[n] in ("article", "main") for n in tops)
    out: list[str] = []
    run: list[str] = []  # linked lines outside an article or main: a menu if two or more

    def end_run() -> None:
        if len(run) < 2:
            out.extend(run)
        run.clear()

    for x, off, good in zip(lines, skipped, content.tolist(), strict=True):
        if off or tops and tops.isdisjoint(x.path):
            continue
        tag = page.tag[x.path[-1]] if x.path else ""
        if not own and not good and x.links >= LINK_SHARE * len(x.text) and tag not in UNLISTED:
            run.append(x.text)
            continue
        end_run()
        out.append(x.text)
    end_run()
    return "\n\n".join(out)


def extract(df: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text) for every row; a NULL or empty page, and one
    without content, has an empty text.

    Very long pages are parsed whole, fed to the parser in pieces.  Repeated
    rows and rows without an id or address each give a row; an empty table
    gives none.  Other columns are not read.
    """
    rows = df.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for p, u, h in row_stream(batches, "page_id", "url", "html"):
            text = main_text(h)
            out.add(len(text) + 64, p, u, text)
            if out.full():
                yield out.batch()
        yield out.batch()

    return rows.mapInArrow(run, "page_id long, url string, text string")
