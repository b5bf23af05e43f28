"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier over a block's place in the tree and its text gives the cost of
calling it content or boilerplate: the capacities to the two terminals. Neighbouring blocks, and blocks under the same
parent, are joined by smoothness edges, stronger the nearer they are in the tree. The minimum cut labels all blocks at
once; blocks on the content side are the main text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm.arrays import string_batches

# HTML elements by their part in a page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
#: Elements that show nothing and so do not end a block.
UNSEEN = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog search fieldset".split())
CONTENT = frozenset("article main".split())
#: A new one of these ends an open one of the same list, as HTML's optional end tags have it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset((
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
).split())
# Parts of names that say what an element is, wherever it stands; and those that also occur in names of what wraps
# the whole page or as anchors in a text.
OWN_PARTS = (
    "ads? advert\\w* banner sponsor\\w* promo\\w* breadcrumbs? cookies? consent gdpr popup modal newsletter subscribe signup login share sharing social "
    "related recommended widget toolbar pagination pager comments? replies reply disqus discussion respond skip")
WRAP_PARTS = "nav\\w* menus? sidebar side footer foot header masthead notices? copyright legal disclaimer search"


def named_by(parts: str) -> re.Pattern:
    return re.compile(rf"(?:^|[_-])(?:{'|'.join(parts.split())})(?:$|[_-])", re.I)


OWN_NAME, WRAP_NAME = named_by(OWN_PARTS), named_by(WRAP_PARTS)
#: A name that ends so is the thing itself, as left-sidebar; one that begins so may be of what wraps it, as sidebar-layout.
WRAP_HEAD = re.compile(rf"(?:^|[_-])(?:{'|'.join(WRAP_PARTS.split())})$", re.I)
#: A name that begins so tells what an element has or is beside, not what it is.
MODIFIER = re.compile(r"(?:has|have|no|with|without|is|not|js|hide|show|layout|page|wide|full)[_-]", re.I)
#: Elements of a running text, whose id is an anchor.
TEXT_TAGS = frozenset("section p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tr td th figure".split())
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body)(?:$|[\s_-])", re.I)
BOILERPLATE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A value begins with a quote or goes on to the next blank or ``>``; a quote anywhere else is part of a name or value.
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=[>\s]|\Z))"""
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</>|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{VALUE})?+|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*))?)?+""", re.I)
SPACE = re.compile(r"\s+")

#: Weights of the classifier: positive speaks for content.
BIAS = 0.4
IN_BOILERPLATE = -8.0
IN_CONTENT = 3.0
LINKS = -3.5
#: In an article links are references, and speak less against it.
LINKS_IN_CONTENT = -1.5
LONG_TEXT = 1.6
SENTENCES = 0.8
LIST_ITEM = -0.5
#: Capacity between neighbours in the same parent; it shrinks with each step of distance in the tree.
SMOOTH = 1.2
DISTANCE = 0.4
#: Capacity between blocks of one parent that do not stand side by side.
SIBLING = 0.3


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    #: Boilerplate by what it is itself, and by what only may wrap the page: an article or main text below ends the latter.
    boiler: bool
    wrapped: bool
    content: bool
    skipped: bool


@dataclass
class Block:
    parent: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def opened(tag: str, attributes: str, parent: Node) -> Node:
    """A child node; what its tag, class, id and role say holds for all that is in it, but for an article or main text below a
    wrapper: a form around the page, or an element whose name only mentions a part of the page."""
    classes: list[str] = []
    anchor, role, hidden = "", "", False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            name = name.lower()
            if name == "class":
                classes += value.split()
            elif name == "id":
                anchor = value.strip()
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    top = tag in ("body", "html")
    content_tag = tag in CONTENT or role in ("main", "article")
    in_text = parent.content and not parent.boiler
    names = [] if top else [x for x in (*classes, anchor) if x and not MODIFIER.match(x)]
    own = any(OWN_NAME.search(x) for x in names)
    parts = [] if content_tag else [x for x in names if not (in_text and tag in TEXT_TAGS and x == anchor)]
    own = own or any(WRAP_HEAD.search(x) for x in parts)
    wraps = any(WRAP_NAME.search(x) for x in parts)
    tagged = tag in BOILERPLATE and not (tag == "header" and in_text)
    hard = not top and (own or role in BOILERPLATE_ROLE - {"form"} or tagged and tag not in ("form", "fieldset"))
    soft = not top and (wraps or tagged or role == "form")
    boiler = parent.boiler or hard or soft and in_text
    wrapped = (parent.wrapped or soft) and not content_tag
    content = parent.content or content_tag or any(CONTENT_NAME.search(x) for x in names)
    return Node(tag, parent, parent.depth + 1, boiler, wrapped, content, parent.skipped or tag in SKIPPED or hidden)


def blocks(page: str) -> list[Block]:
    """Runs of text between the tags of block elements, in page order; unclosed and cut-off markup is tolerated."""
    root = Node("", None, 0, False, False, False, False)
    node, found, current, links, at = root, [], None, 0, 0

    def add(text: str) -> None:
        nonlocal current
        if not text or node.skipped or (current is None and not text.strip()):
            return
        if current is None:
            holder = node
            while holder.tag in INLINE and holder.parent:
                holder = holder.parent
            current = Block(holder)
            found.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    while at <= len(page):
        match = TAG.search(page, at)
        add(page[at:match.start()] if match else page[at:])
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if match[0].startswith("<![CDATA["):
            add(html.escape(match[0][9:].removesuffix("]]>")))
        if not tag:
            if at == match.start():
                at += 1
            continue
        if tag not in INLINE and tag not in UNSEEN:
            if tag in ("br", "wbr"):
                if current is not None and tag == "br":
                    current.parts.append(" ")
                continue
            if tag in VOID and tag != "hr":
                continue
            current = None
        if match[1]:
            up = node
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE or up.tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html") and up.tag != tag:
                    up = root  # an end tag without its begin is ignored
                    break
                up = up.parent
            if up is not root:
                walk = node
                while walk is not up.parent:
                    links -= walk.tag == "a"
                    walk = walk.parent
                node = up.parent
            continue
        if tag == "hr":
            continue
        ends = {"p"} if tag in ENDS_P else ENDS.get(tag)
        if ends:
            up = node
            while up is not root and up.tag not in ends and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up is not root and up.tag in ends:
                walk = node
                while walk is not up.parent:
                    links -= walk.tag == "a"
                    walk = walk.parent
                node = up.parent
        node = opened(tag, match[3] or "", node)
        links += tag == "a"
        if match[0].endswith("/>") and tag not in INLINE:
            node = node.parent
        elif tag in ("script", "style", "textarea", "title"):  # raw text: no tags inside
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page) + 1
            node = node.parent
    return found


def belief(block: Block, text: str) -> float:
    """Linear classifier: how much speaks for content."""
    n = len(text)
    boiler = block.parent.boiler or block.parent.wrapped
    links = LINKS_IN_CONTENT if block.parent.content and not boiler else LINKS
    score = BIAS + IN_BOILERPLATE * boiler + IN_CONTENT * block.parent.content
    score += links * min(1.0, block.linked / max(1, n)) + LONG_TEXT * min(1.0, n / 200)
    score += SENTENCES * (text[-1:] in ".!?。！？…\"”»" and n > 20) + LIST_ITEM * (block.parent.tag == "li")
    return score


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Network:
    """Maximum flow from a source to a sink; all shortest paths are filled together, so a few rounds do for a long page."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.left: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, capacity in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(capacity)

    def steps(self, source: int) -> dict[int, int]:
        """Nodes that can still be reached, with their number of steps from the source."""
        seen, line = {source: 0}, [source]
        for x in line:
            for e in self.out[x]:
                if self.left[e] > 1e-9 and self.to[e] not in seen:
                    seen[self.to[e]] = seen[x] + 1
                    line.append(self.to[e])
        return seen

    def push(self, source: int, sink: int, steps: dict[int, int]) -> None:
        """Push as much as the shortest paths can take; every edge is given up once at most."""
        at = [0] * len(self.out)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                amount = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= amount
                    self.left[e ^ 1] += amount
                full = next(i for i, e in enumerate(path) if self.left[e] <= 1e-9)
                x = self.to[path[full] ^ 1]
                del path[full:]
            elif at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                if self.left[e] > 1e-9 and steps.get(self.to[e]) == steps[x] + 1:
                    path.append(e)
                    x = self.to[e]
                else:
                    at[x] += 1
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return

    def cut(self, source: int, sink: int) -> dict[int, int]:
        """Push as much as can be; the nodes on the source's side of the minimum cut."""
        while sink in (steps := self.steps(source)):
            self.push(source, sink, steps)
        return steps


def label(found: list[Block], texts: list[str]) -> list[bool]:
    """Content or boilerplate for each block by the minimum cut."""
    beliefs = [belief(b, t) for b, t in zip(found, texts)]
    if min(beliefs) > 0 or max(beliefs) <= 0:  # no cut separates equal signs: all capacities lead to one terminal
        return [x > 0 for x in beliefs]
    n = len(found)
    flow = Network(n + 2)
    for i, x in enumerate(beliefs):
        if x > 0:
            flow.edge(n, i, x)
        else:
            flow.edge(i, n + 1, -x)
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        near = last.get(id(block.parent.parent))
        if i:
            capacity = SMOOTH * max(0.0, 1 - DISTANCE * max(0, distance(found[i - 1].parent, block.parent) - 2))
            if capacity:
                flow.edge(i - 1, i, capacity, capacity)
        if near is not None and near != i - 1:
            flow.edge(near, i, SIBLING, SIBLING)
        last[id(block.parent.parent)] = i
    side = flow.cut(n, n + 1)
    return [i in side for i in range(n)]


def main_text(page: str | None) -> str:
    """The content blocks of a page, one to a line; empty for a null or a page without content."""
    pairs = [(b, t) for b in blocks(page or "") if (t := b.text())]
    if not pairs:
        return ""
    kept = label([b for b, _ in pairs], [t for _, t in pairs])
    return "\n".join(t for (_, t), keep in zip(pairs, kept) if keep)


@F.arrow_udf(T.StringType())
def extracted(batch: pa.Array) -> pa.Array:
    return pa.array([main_text(page) for page in string_batches(batch).to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null and empty html give the empty text; repeated rows repeat."""
    return pages.select("page_id", "url", extracted(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
