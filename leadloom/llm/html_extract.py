"""Main text of HTML pages by tree scoring.

The page is parsed to a tree of blocks. Paragraph-like elements with enough text pass points (one, one
per comma, one per LENGTH_STEP characters up to three) to their ancestors: in full to the parent, half to
the grandparent, a third of that and less further up. A container's score is its points, plus what its tag and class
or id names speak for, discounted by its link density. The container with the best score is kept,
together with siblings that score well beside it or are text-like paragraphs without links. Elements
that never hold the article (navigation, headers and footers of the page, asides, forms, scripts, styles,
notices, adverts, reader comments) are taken out first. If nothing scores, the body's remaining text counts; if nothing remains, the page is read again
and names of classes and ids, but those of comments, are left out of account.

Cases: null and empty html give no text; tags that are never closed end with their parent, and a new
paragraph or list item ends an open one; markup that is cut off in the middle is read as far as it goes;
repeated pages are treated alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title".split())
CHROME = frozenset("nav aside form footer dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that pass points to their ancestors.
SCORED = frozenset("p pre td blockquote li dd".split())
#: What the names of a class or id say: parts that are never the article, and parts that may be.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|share|sharing|social|"
    r"related|recommend\w*|sidebar|side|nav\w*|menu\w*|breadcrumbs?|foot\w*|masthead|discussion|"
    r"login|signup|search|pagination|pager|widget|toolbar|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names of reader comments, whatever the element.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus)(?:$|[\s_-])", re.IGNORECASE)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:header|tags|meta|info|byline)(?:$|[\s_-])", re.IGNORECASE)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text|page|blog)(?:$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
TAG_POINTS = {"article": 25, "main": 20, "section": 3, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "table": 0, "body": 0}
#: Open elements that a start tag ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A tag that the end of the page cuts off.
CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")
#: What a short paragraph beside the article ends with, if it belongs to it.
SENTENCE_ENDS = ".!?…:;\"'”’»)"
LENGTH_STEP, LENGTH_POINTS, LEAST_CHARS = 100, 3, 25


class Node:
    __slots__ = ("tag", "names", "role", "parent", "parts", "hidden", "points", "chars", "link_chars")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".strip()
        self.role = (attrs.get("role") or "").lower()
        self.hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.chars = self.link_chars = 0


class Tree(HTMLParser):
    """The element tree; what is in raw elements is left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("html", {}, None)
        self.raw = ""
        self.depth = 0
        self.feed(CUT_OFF.sub("", html))
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.raw:
            self.depth += tag == self.raw
            return
        if tag in RAW:
            self.raw, self.depth = tag, 1
            return
        if tag in ("html", "head"):
            return
        if tag in BLOCKS and tag != "br":
            self._end({"p"}, BLOCKS - {"p", "br"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, dict(attrs), self.now)
        self.now.parts.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in RAW:  # a raw element that closes itself hides nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag == self.raw:
                self.depth -= 1
                if not self.depth:
                    self.raw = ""
            return
        self._end({tag}, {"td", "th"} if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html") else set())

    def _end(self, tags: set, stops: set) -> None:
        node = self.now
        while node is not None and node.parent is not None:
            if node.tag in tags:
                self.now = node.parent
                return
            if node.tag in stops:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.now.parts.append(data)


def _unwanted(node: Node, by_name: bool) -> bool:
    """Whether an element can't hold the article, by its tag, role and names."""
    if node.hidden or node.tag in CHROME or node.role in ROLES:
        return True
    if node.tag not in ("body", "html") and node.names and COMMENTS.search(node.names):
        return True
    if node.tag == "header":  # of the page; an article may have a header with its title
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return by_name and node.tag not in ("body", "article", "main", "html") and bool(
        node.names and (UNLIKELY.search(node.names) or DOUBTFUL.search(node.names) and not LIKELY.search(node.names))
    )


def _elements(root: Node, by_name: bool) -> list[Node]:
    """All elements in page order, without those that can't hold the article (which are cut off the tree)."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.parts = [x for x in node.parts if isinstance(x, str) or not _unwanted(x, by_name)]
        stack.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    return out


def _count(nodes: list[Node]) -> None:
    """Characters and characters in links of every element."""
    for node in reversed(nodes):
        own = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str))
        below = [x for x in node.parts if not isinstance(x, str)]
        node.chars = own + sum(x.chars for x in below)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in below)


def _commas(node: Node) -> int:
    stack, n = [node], 0
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, str):
                n += x.count(",") + x.count("،") + x.count("、") + x.count("，")
            elif x.tag not in SCORED:
                stack.append(x)
    return n


def _is_paragraph(node: Node) -> bool:
    """Whether a container holds text without blocks of its own, as where line breaks stand for paragraphs."""
    return all(isinstance(x, str) or x.tag == "br" or x.tag not in BLOCKS for x in node.parts)


def blocks_of(nodes: list[Node | str]) -> list[str]:
    """The texts of the blocks of some nodes, in page order."""
    out, line = [], []

    def done() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            done()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in BLOCKS:
            done()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            stack.extend(reversed(x.parts))
    done()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page; where taking out by names leaves nothing, the page is read again without it."""
    return (_scored_text(html, True) or _scored_text(html, False)) if html else ""


def _scored_text(html: str, by_name: bool) -> str:
    root = Tree(html).root
    nodes = _elements(root, by_name)
    _count(nodes)
    scores: dict[int, float] = {}
    for node in nodes:
        if node.chars < LEAST_CHARS or not (node.tag in SCORED or node.tag == "div" and _is_paragraph(node)):
            continue
        points = 1 + _commas(node) + min(LENGTH_POINTS, node.chars // LENGTH_STEP)
        points *= 1 - node.link_chars / node.chars
        up, level = node.parent, 0
        while up is not None and level < 5:
            if id(up) not in scores:
                scores[id(up)] = TAG_POINTS.get(up.tag, 0) + (25 if LIKELY.search(up.names) else 0) * bool(up.names)
            scores[id(up)] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    rated = {id(x): scores[id(x)] * (1 - x.link_chars / x.chars) for x in nodes if id(x) in scores and x.chars}
    if not rated:
        return " ".join(blocks_of(root.parts))
    best = max((x for x in nodes if id(x) in rated), key=lambda x: rated[id(x)])
    kept: list[Node | str] = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * rated[id(best)])
        kept = []
        for x in best.parent.parts:
            if x is best:
                kept.append(x)
            elif not isinstance(x, str) and x.chars:
                density = x.link_chars / x.chars
                same = 0.2 * rated[id(best)] if x.names and x.names == best.names else 0
                text_like = x.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "ul", "ol", "table", "figure") and density < 0.25 and (x.chars >= 80 or x.tag[0] == "h" or not x.link_chars and _is_sentence(x))
                if rated.get(id(x), 0) + same >= least or text_like and best.tag not in ("article", "main"):
                    kept.append(x)
    return " ".join(blocks_of(kept))


def _is_sentence(node: Node) -> bool:
    return (" ".join(blocks_of([node])) or " ")[-1] in SENTENCE_ENDS


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
