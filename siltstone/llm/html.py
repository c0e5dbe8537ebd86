r"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root to
it.  Per path, text length, punctuation, link text and the number of blocks
are added up; a path's ratio is its text for each block, raised by punctuation
and lowered by links.  The ratios are smoothed over neighbouring blocks, fused
with the paths' own, and blocks above a share of the page's mean are content
nodes, as is the page's title (``h1``) where it is not a link.  The innermost
container that holds all of them is the article (one that says so goes before
others); every block in it is kept, so headings and short paragraphs stay.  Paths through
elements that are never article text (navigation, headers, footers, asides,
forms, adverts, notices, reader comments, scripts, styles) have ratio zero;
inside a block the text of such an element (an inline advert, a hidden mark)
is left out alone.

Each page is worked on by itself: no shuffle.  Elements are a tree of parent
pointers, so time and memory grow with the page, however deep it is nested.

Defined results: null, empty or text-free pages have the empty text; unclosed
and misnested tags end with the element around them; very long and very deep
pages are read whole; repeated rows and null
ids are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: Element names by their role (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("head nav header footer aside form button select option dialog menu fieldset figure-ad".split()) | RAW
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements that an implied end does not pass.
WALLS = frozenset("html body article main section div table ul ol dl nav aside header footer form blockquote".split())
#: Elements that can be the article; those of ``ARTICLE`` go before the others.
ARTICLE = frozenset(["article", "main"])
CONTAINERS = ARTICLE | frozenset("html body section div td center".split())
#: Names in class, id or role that mark what is never article text.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|masthead|header|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|pagination|pager|skip|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Inside an article a name counts when all its parts are marks or words of layout; headers there are the article's own.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|pagination|pager|skip|contentinfo|complementary|search)", re.IGNORECASE)
LAYOUT = frozenset("area article articles bar block box btn button buttons col column container content entry form group icons inner item items left link links list main media page panel post posts right section site slot stories thread top bottom unit user widget widgets wrap wrapper".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.DOTALL)
#: An attribute's name and value; taken in turn, so names inside a value are its text.
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

#: Share of the mean fused ratio that a content node needs.
THRESHOLD = 0.3


def _compound(name: str) -> bool:
    """Whether a class, id or role is made of marks and words of layout alone: ``related-posts`` is, ``related-work`` is not."""
    parts = [x for x in re.split(r"[_-]+|\d+", name) if x]
    return any(_PART.fullmatch(x) for x in parts) and all(x.lower() in LAYOUT or _PART.fullmatch(x) for x in parts)


def _is_marked(name: str, marks: dict[str, str], inside: bool) -> bool:
    """Whether an element's names say that it is never article text; ids of headings and sections may be slugs of their titles."""
    own = marks.get("id", "")
    if name in _HEADINGS or ((name == "section" or "section" in marks.get("class", "").lower().split()) and own.lower() not in ("comments", "respond")):
        own = ""
    if not inside:
        return any(_MARKED.search(x) for x in (marks.get("class", ""), own, marks.get("role", "")))
    return name != "header" and any(_compound(x) for x in [*marks.get("class", "").split(), own, *marks.get("role", "").split()])


@dataclass
class Block:
    path: int  # the number of its path of tags
    node: int  # the element around it that is not inline, by number; 0 is the page
    text: str
    links: int  # characters of link text
    barred: bool
    title: bool = False


class Page:
    """The blocks of a page in page order, and the tree of its elements by parent pointers.

    Elements are numbered as they start, so the elements inside one are a run of
    numbers and the innermost of two is the one with the higher number.
    """

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parents, self.names, self.last = [0], [""], [0]
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[int, str, int, bool]] = [(0, "", 0, False)]  # number, name, path, barred, from the page inwards
        self._open: dict[str, list[int]] = {}  # places in the stack of open elements, by name
        self._walls: list[int] = []
        self._words: list[tuple[str, bool]] = []
        self._links = 0
        self._read(html)
        self._flush()
        self._pop(1)
        self.last[0] = len(self.parents) - 1

    def _flush(self) -> None:
        """Ends a block: runs of barred text inside it (an inline advert, a hidden mark) are not its text."""
        if not self._words:
            return
        at = len(self._stack) - 1
        while at and self._stack[at][1] in INLINE:
            at -= 1
        number, _, path, _ = self._stack[at]
        title = any(i <= at for i in self._open.get("h1", ())[:1])
        for barred in (False, True):
            text = " ".join("".join(w for w, b in self._words if b == barred or not w.strip()).split())
            if text:
                self.blocks.append(Block(path, number, text, 0 if barred else self._links, barred, title))
        self._words.clear()
        self._links = 0

    def _add(self, raw: str) -> None:
        barred, text = self._stack[-1][3], unescape(raw)
        self._words.append((text, barred))
        if self._open.get("a") and not barred:
            self._links += len(text.strip())

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            number, name, _, _ = self._stack.pop()
            self.last[number] = len(self.parents) - 1
            self._open[name].pop()
            if name in WALLS:
                self._walls.pop()

    def _push(self, name: str, marks: dict[str, str]) -> None:
        number, path, barred = self._stack[-1][0], self._stack[-1][2], self._stack[-1][3]
        inside = bool(self._open.get("article") or self._open.get("main"))
        never = (name in NEVER and not (name == "header" and inside)) or "hidden" in marks
        never = never or (name not in ("html", "body", "article", "main") and _is_marked(name, marks, inside))
        label = name + "".join("." + c for c in sorted(re.sub(r"\d+", "", marks.get("class", "")).split()))
        # A path is its parent's number and its own last tag, so a deep page's paths take no more room than its tags.
        path = path if name in INLINE else self._paths.setdefault((path, label), len(self._paths) + 1)
        self.parents.append(number)
        self.names.append(name)
        self.last.append(0)
        self._open.setdefault(name, []).append(len(self._stack))
        if name in WALLS:
            self._walls.append(len(self._stack))
        self._stack.append((len(self.parents) - 1, name, path, barred or never))

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._words.append((" ", self._stack[-1][3]))
            return
        if name not in INLINE:
            self._flush()
            # The outermost of the elements that it ends, within the innermost wall.
            wall, ends = self._walls[-1] if self._walls else 0, []
            for closed in ("p", *CLOSES.get(name, ())):
                places = self._open.get(closed, ())
                first = bisect_right(places, wall)
                ends += places[first : first + 1]
            if ends:
                self._pop(min(ends))
        if name not in VOID:
            self._push(name, {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {})

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        places = self._open.get(name)
        if places:
            self._pop(places[-1])

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            token = _TOKEN.search(html, at)
            if not token:
                self._add(html[at:])
                break
            if token.start() > at:
                self._add(html[at : token.start()])
            at = token.end()
            if token[1]:
                self._end(token[1].lower())
            elif token[2]:
                name = token[2].lower()
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
                else:
                    self._start(name, token[3])

    def around(self, found: list[Block]) -> int:
        """The innermost container of all of ``found``; one that says that it is the article goes before others, 0 is the page."""
        low, high = min(b.node for b in found), max(b.node for b in found)
        while not low <= high <= self.last[low]:  # all lie in one that holds the first and the last of them
            low = self.parents[low]
        node, inner = low, None
        while node:
            if self.names[node] in ARTICLE:
                return node
            if inner is None and self.names[node] in CONTAINERS:
                inner = node
            node = self.parents[node]
        return inner or 0


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in page order, white space turned into single spaces."""
    return Page(html).blocks


def path_scores(found: list[Block]) -> list[float]:
    """Each block's fused ratio: that of its path and that of its neighbours."""
    text, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        if not b.barred:
            text[b.path] += len(b.text)
            marks[b.path] += len(_PUNCTUATION.findall(b.text))
            links[b.path] += min(b.links, len(b.text))
            count[b.path] += 1
    ratio = {p: text[p] / n * (1 + marks[p] / n) * (1 - links[p] / text[p]) for p, n in count.items()}
    own = [0.0 if b.barred else ratio[b.path] for b in found]
    smooth = []
    for i, x in enumerate(own):
        around = [own[j] * w for j, w in ((i - 1, 0.5), (i + 1, 0.5)) if 0 <= j < len(own)]
        smooth.append(0.0 if found[i].barred else (x + sum(around)) / (1 + 0.5 * len(around)))
    return [(a * b) ** 0.5 if a else b / 2 for a, b in zip(own, smooth, strict=True)]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one ``\\n``; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    found = page.blocks
    scores = path_scores(found)
    open_ = [i for i, b in enumerate(found) if not b.barred]
    if not open_:
        return ""
    mean = sum(scores[i] * len(found[i].text) for i in open_) / sum(len(found[i].text) for i in open_)
    content = [i for i in open_ if scores[i] >= THRESHOLD * mean or (found[i].title and found[i].links < len(found[i].text))]
    article = page.around([found[i] for i in content])
    return "\n".join(found[i].text for i in open_ if article <= found[i].node <= page.last[article])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` and ``text``, one row per page."""
    ship(pages.sparkSession)
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_extract, f"{schema}, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
