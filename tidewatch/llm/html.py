"""Main text of HTML pages by composite text density.

A tolerant tree is built from the page. For every node: characters C, link characters LC,
tags T and link tags LT below it. Its density is

    C / T * log(C * T / (LC * LT)) to base ln(C / nLC * LC + LC / C' * C + e)

with nLC = C - LC, T and LT at least 1, and C' the body's characters: text of many
characters a tag and few links is dense. DensitySum is the sum of the children's densities.
The subtree of the greatest DensitySum is the core of the main text. The threshold is the
least density on the path from the body to it. On that path, up to an <article> or <main>,
every subtree beside it that reaches the threshold is main text too, with what stands
between such subtrees and is no block of more than a third links, and a heading right before the first;
other nodes below the threshold are no content. If the core is the body itself, blocks in it
below the threshold that are more than a third links are no content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas".split())
SKIPPED = RAW | frozenset("head nav header footer aside form button select textarea menu dialog title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th".split())
CLOSES_P = BLOCKS - {"body", "html"}
#: An open element of the first kind ends when the second kind starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "p": CLOSES_P}
#: Elements that a start tag can end, and those that stop the search for one.
STOPS = BLOCKS | frozenset(ENDS)


def named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: Words in class or id that name something other than the article: in any element, in containers, and in those
#: unless another word names the article. Reader comments go whatever else their name holds.
COMMENTS = named("comments?|commentlist|disqus|replies|respond")
BOILERPLATE = named(r"ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|header|menu|nav|navbar|navigation|notices?|sidebar|sidenav|site-?header|site-?footer")
BESIDE = named(r"modal|newsletter|popup|promo\w*|related|share|sharing|skip|social|sponsor\w*|subscribe|toolbar|widget")
MAIN = named("article|main|content|post|entry|story")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())


class Node:
    __slots__ = ("tag", "skip", "children", "chars", "link_chars", "tags", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, skip: bool = False):
        self.tag, self.skip, self.children = tag, skip, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.density_sum = 0.0


class TreeBuilder(HTMLParser):
    """Nodes of what is not skipped; text pieces are strings among the children. Time is linear in the page, however its tags nest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]
        self.stops: list[int] = []  # depths of open elements in STOPS
        self.opened: dict[str, list[int]] = {}  # depths of open elements by tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        for depth in reversed(self.stops):  # implied ends
            open_tag = self.stack[depth].tag
            if tag in ENDS.get(open_tag, ()):
                self.close_from(depth)
                break
            if open_tag in BLOCKS and open_tag != "p":
                break
        inside = bool(self.opened.get("article") or self.opened.get("main"))
        skipped = tag in SKIPPED and not (tag == "header" and inside)  # an article's own header has its title
        node = Node(tag, skipped or self.named_boilerplate(tag, attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            depth = len(self.stack)
            self.stack.append(node)
            self.opened.setdefault(tag, []).append(depth)
            if tag in STOPS:
                self.stops.append(depth)

    def close_from(self, depth: int) -> None:
        """End the open elements from this depth on."""
        while len(self.stack) > depth:
            self.opened[self.stack.pop().tag].pop()
        while self.stops and self.stops[-1] >= depth:
            self.stops.pop()

    def named_boilerplate(self, tag: str, attrs: list) -> bool:
        if tag in ("article", "main", "body"):
            return False
        container = tag in CONTAINERS
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return True
            elif name in ("class", "id"):
                if COMMENTS.search(value) or (BOILERPLATE.search(value) or container and BESIDE.search(value)) and not MAIN.search(value):
                    return True
            elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.opened.get(tag):
            self.close_from(self.opened[tag][-1])

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def order(root: Node) -> list[Node]:
    """Every node that counts, parents first; no recursion, so depth is no limit."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.skip)
    return out


def measure(root: Node) -> list[Node]:
    nodes = order(root)
    for node in reversed(nodes):
        for x in node.children:
            if isinstance(x, str):
                n = len(x) - x.count(" ") if not x.isspace() else 0
                node.chars += n
            elif not x.skip:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    c_body, lc_body = max(1, root.chars), root.link_chars
    for node in nodes:
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if c:
            plain = max(1, c - lc)
            base = math.log(c / plain * lc + lc_body / c_body * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base if lc < c else 0.0
    for node in reversed(nodes):
        node.density_sum = sum(x.density for x in node.children if isinstance(x, Node) and not x.skip)
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        if own and node.tag not in ("a", "p"):
            node.density_sum += own  # text right in the node, with no tag of its own
    return nodes


def choose(root: Node) -> Node:
    """The main text's outermost node; what isn't main text is taken out of its children."""
    nodes = measure(root)
    parent = {id(x): n for n in nodes for x in n.children if isinstance(x, Node) and not x.skip}
    blocks = [n for n in nodes if n is root or n.tag in CONTAINERS]
    best = max(blocks, key=lambda n: n.density_sum)
    threshold, at = best.density, best
    while at is not root:
        at = parent[id(at)]
        threshold = min(threshold, at.density)
    while best is not root:  # wrappers that hold all the article's blocks
        up = parent[id(best)]
        if up is root or up.chars > best.chars * 1.5 or up.tag not in ("article", "main"):
            break
        best = up
    for n in nodes:  # one element that the page itself calls the article
        if n.tag == "article" and n is not best and n.chars >= best.chars and contains(n, best):
            return n
    if best is root:
        root.children = [x for x in root.children if isinstance(x, str) or x.density >= threshold or not link_heavy(x)]
    at = best
    while at is not root and at.tag not in ("article", "main"):
        up = parent[id(at)]
        if widened(up, at, best, threshold):
            best = up
        at = up
    return best


def link_heavy(node: Node) -> bool:
    return node.tag in CONTAINERS and 3 * node.link_chars > node.chars


def widened(up: Node, at: Node, best: Node, threshold: float) -> bool:
    """Whether a child of `up` beside `at` reaches the threshold; then only main text stays among its children."""
    passed = [i for i, x in enumerate(up.children) if x is at or isinstance(x, Node) and not x.skip and x.chars and x.density >= threshold]
    if len(passed) < 2:
        return False
    first, last = passed[0], passed[-1]
    before = next((i for i in range(first - 1, -1, -1) if not isinstance(up.children[i], str) or up.children[i].strip()), -1)
    if before >= 0 and isinstance(up.children[before], Node) and up.children[before].tag in HEADINGS:
        first = before
    among = set(passed)
    kept = [best if x is at else x for i, x in enumerate(up.children) if i in among or first <= i <= last and (isinstance(x, str) or not link_heavy(x))]
    up.children = kept
    return True


def contains(outer: Node, inner: Node) -> bool:
    waiting = [outer]
    while waiting:
        n = waiting.pop()
        if n is inner:
            return True
        waiting.extend(x for x in n.children if isinstance(x, Node))
    return False


def blocks_of(node: Node) -> Iterator[str]:
    """Texts of the blocks in page order, white space turned into one blank."""
    pieces: list[str] = []

    def text() -> str:
        out = " ".join("".join(pieces).split())
        pieces.clear()
        return out

    waiting: list = [node]
    while waiting:
        x = waiting.pop()
        if x is None:
            if out := text():
                yield out
        elif isinstance(x, str):
            pieces.append(x)
        elif not x.skip or x is node:
            block = x.tag in BLOCKS
            if x.tag == "br":
                pieces.append(" ")
            waiting.extend([None] * block + x.children[::-1] + [None] * block)
    if out := text():
        yield out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n".join(blocks_of(choose(builder.root)))


def extract(df: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`df` without `html`, with the main text of each page (`into`) and its `n_chars`.

    Null and empty pages, and pages without text, give the empty string; repeated rows give equal
    ones, and pages of any length or depth are read whole. Any white space of Unicode, no-break
    spaces included, counts as white space. Columns named like the added ones are replaced.
    """
    keep = [c for c in df.columns if c not in (html, into, "n_chars")]
    schema = df.select(*keep).schema.add(into, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, into, "n_chars"])

    return df.select(*keep, html).mapInArrow(run, schema)
