"""Main text of web pages by composite text density.

Parts that name themselves as menus, adverts and the like are taken out first; inside the article only those of which a
whole class says so, or that are mostly links, and never a form or a named part with most of the page's text. Every node that is left gets its
characters per tag, adjusted for links. The node whose children's densities sum up to most holds the article; it is read
with the rest of its article element, if it has one, or with the page's title and with the parts beside its path to the
body that are at least as dense as the least dense element of the path, each by its own such node. Lists of links whose density is less than
the least on the path from there to the body are left out, and nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import slices

# The elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("button caption html body option optgroup td th tr tbody thead tfoot legend".split())
SIBLINGS = {  # an element that ends when one of these starts, up to the given container
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
    "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}

# What parts of a page are often called that are not the article: a tuned choice, which density and size overrule.
OTHER_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe object embed canvas svg select button dialog menu head title textarea".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies "
    "consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar widget "
    "widgets pagination pager masthead".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
HEADER_NAMES = frozenset("header topbar".split())
# Elements that hold running text; a part without any is no piece of an article that stands apart from the rest.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd blockquote pre td figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    attributes: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)  # texts and nodes, in page order
    dropped: bool = False
    chars: int = 0
    links: int = 0  # characters inside links
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0  # of the children's densities
    all_chars: int = 0  # the same with the dropped parts
    all_links: int = 0

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _end(at: Node, tags: frozenset[str], until: frozenset[str]) -> Node:
    """Closes the open elements of ``tags`` below the nearest of ``until``; the open element after that."""
    node = at
    while node.parent is not None and node.tag not in until:
        if node.tag in tags:
            at = node.parent
        node = node.parent
    return at


_P, _P_SCOPE = frozenset(["p"]), frozenset("html body table td th button caption object".split())


def parse(html: str) -> list[Node]:
    """All elements in page order; the first is the root. Any text is a page: missing and wrong ends are mended."""
    root = Node("html", None)
    nodes, at, place = [root], root, 0
    opened = Counter(["html"])  # so that ends are looked for only where there are any

    def climb(to: Node) -> Node:
        node = at
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while place < len(html):
        found = _TOKEN.search(html, place)
        if found is None:
            at.parts.append(unescape(html[place:]))
            break
        if found.start() > place:
            at.parts.append(unescape(html[place : found.start()]))
        place = found.end()
        if found[0].startswith("<![CDATA["):
            at.parts.append(re.sub(r"\]\]>$", "", found[0][9:]))
        if not found[2] or not found[4]:
            continue  # a comment, or a tag that the page's end cuts off
        tag = found[2].lower()
        if found[1]:
            if opened[tag] and tag != "html":
                node = at
                while node.tag != tag:
                    node = node.parent
                at = climb(node.parent)
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in CLOSES_P and opened["p"]:
            at = climb(_end(at, _P, _P_SCOPE))
        if tag in SIBLINGS and any(opened[t] for t in SIBLINGS[tag][0]):
            at = climb(_end(at, *SIBLINGS[tag]))
        node = Node(tag, at, {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(found[3])})
        at.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, place)
            node.parts.append(html[place : close.start() if close else len(html)])
            place = close.end() if close else len(html)
        elif tag not in VOID and not found[3].endswith("/"):
            at = node
            opened[tag] += 1
    return nodes


def _above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _names(node: Node) -> set[str]:
    return set(_NAME.findall(f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower()))


def _count(nodes: list[Node]) -> None:
    """Characters of every node and those inside links, before anything is dropped."""
    in_link: set[int] = set()
    for node in nodes:
        if node.tag == "a" or node.parent is not None and id(node.parent) in in_link:
            in_link.add(id(node))
    for node in reversed(nodes):
        own = 0 if node.tag in RAW else sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.all_chars += own
        node.all_links += own * (id(node) in in_link)
        if node.parent is not None:
            node.parent.all_chars += node.all_chars
            node.parent.all_links += node.all_links


def _says_so(node: Node, names: frozenset[str]) -> bool:
    """Is one of the node's classes made of such names only, or the node mostly links?"""
    classes = (_NAME.findall(c) for c in node.attributes.get("class", "").lower().split())
    return any(c and names.issuperset(c) for c in classes) or 2 * node.all_links > node.all_chars


def _drop_other_parts(nodes: list[Node], scope: Node | None = None) -> None:
    """Marks what calls itself something else than the article. A part that holds the article element, and a form or a
    named part that holds most of the page's text, stays; so does one named like comments beside which there is no article,
    neither as an element nor by a fifth of the text. Inside ``scope`` a word of a name alone is not enough."""
    told = any(n.tag in ("article", "main") and not _names(n) & COMMENT_NAMES for n in nodes)
    aside = {id(n) for n in nodes if n.tag in OTHER_TAGS and n.tag != "form" and not any(a.tag in OTHER_TAGS for a in _above(n))}
    text = nodes[0].all_chars - sum(n.all_chars for n in nodes if id(n) in aside)
    holds = {id(a) for n in nodes if n.tag in ("article", "main") and not _names(n) & COMMENT_NAMES for a in (n, *_above(n))}
    inside: set[int] = set()
    within: set[int] = set()
    for node in nodes:
        node.dropped = node.parent is not None and node.parent.dropped
        if node.dropped:
            continue
        if node.tag in ("article", "main") or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        if node.parent is not None and (node.parent is scope or id(node.parent) in within):
            within.add(id(node))
        if node.parent is None or node.tag == "body":
            continue
        names, role = _names(node), node.attributes.get("role", "").lower()
        sure = id(node) not in within
        most = 2 * node.all_chars > nodes[0].all_chars
        head = node.tag == "header" or names & HEADER_NAMES and (sure or _says_so(node, HEADER_NAMES))
        hidden = "hidden" in node.attributes or re.search(r"display\s*:\s*none", node.attributes.get("style", ""), re.I)
        named = names & OTHER_NAMES and not most and (sure or _says_so(node, OTHER_NAMES))
        tag = node.tag in OTHER_TAGS and not (node.tag == "form" and most)
        only = not told and 5 * node.all_chars > 4 * text
        comment = names & COMMENT_NAMES and not only and (sure or _says_so(node, COMMENT_NAMES))
        other = tag or role in OTHER_ROLES and not (role == "form" and most) or named or head and id(node) not in inside or hidden
        node.dropped = bool(comment or other) and id(node) not in holds


def _measure(nodes: list[Node]) -> None:
    """Densities and their sums, without the dropped parts; how much of a page is links is taken with them."""
    in_link: dict[int, bool] = {}
    for node in nodes:
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density = node.total = 0.0
        in_link[id(node)] = node.tag == "a" or (node.parent is not None and in_link[id(node.parent)])
    every = linked = 0
    for node in reversed(nodes):
        own = 0 if node.tag in RAW else sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        every += own
        linked += own * in_link[id(node)]
        if node.dropped:
            continue
        node.chars += own
        node.links += own * in_link[id(node)]
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.tags += node.tags + 1
            node.parent.link_tags += node.link_tags + (node.tag == "a")
    share = linked / max(every, 1)
    for node in nodes:
        if not node.dropped and node.chars:
            plain = max(node.chars - node.links, 1)
            tags = max(node.tags, 1)
            # One more than in the published formula, whose base is 1 on pages without links.
            base = 1 + math.log(node.chars / plain * node.links + share * node.chars + math.e)
            value = node.chars / max(node.links, 1) * tags / max(node.link_tags, 1)
            node.density = max(node.chars / tags * math.log(value, base), 0.0) if value > 0 else 0.0
    for node in nodes:
        if node.parent is not None and node.tag in BLOCKS:  # words in bold are no part of a page
            node.parent.total += node.density


def _place(nodes: list[Node]) -> tuple[Node, set[int], float]:
    """The element to read, the titles that stand before it, and the least density on its path to the body."""
    best = nodes[0]
    for node in nodes:
        if not node.dropped and node.total >= best.total:  # of equal ones the last, which is the innermost
            best = node
    path = [best, *_above(best)]
    scope = next((n for n in path if n.tag in ("article", "main")), best)
    titles = {id(c) for n in _above(scope) for c in n.nodes() if c.tag in ("h1", "hgroup") and not c.dropped}
    return scope, titles, min(n.density for n in path)


def _is_list_of_links(node: Node, threshold: float) -> bool:
    return node.tag in BLOCKS and node.link_tags > 1 and 2 * node.links > node.chars and node.density < threshold


def _beside(scope: Node, threshold: float) -> list[Node]:
    """What to read besides the chosen node: of each part beside its path that reaches the threshold, and half of the
    chosen node's density, and has elements of running text, the node of the greatest sum. None if there is an article
    element."""
    path = [scope, *_above(scope)]
    if any(n.tag in ("article", "main") for n in path):
        return []
    found = []
    for own, parent in zip(path, path[1:]):
        for part in parent.nodes():
            if part is own or part.dropped or part.tag not in BLOCKS or not part.chars or part.density < threshold or 2 * part.links > part.chars:
                continue
            best, waiting, runs = part, [part], False
            while waiting:
                node = waiting.pop()
                runs |= node.tag in TEXT_TAGS
                if node.total > best.total:
                    best = node
                waiting.extend(n for n in node.nodes() if not n.dropped)
            if runs and 2 * part.density >= scope.density:
                found.append(best)
    return found


def main_text(html: str) -> str:
    nodes = parse(html)
    _count(nodes)
    _drop_other_parts(nodes)
    _measure(nodes)
    scope, titles, threshold = _place(nodes)
    before = [n.dropped for n in nodes]
    _drop_other_parts(nodes, scope)
    if before != [n.dropped for n in nodes]:  # the article has parts back
        _measure(nodes)
        threshold = min(n.density for n in (scope, *_above(scope)))
    scopes = [scope, *_beside(scope, threshold)]
    read = set(map(id, scopes))
    way = read | {id(a) for n in scopes for a in _above(n)}
    blocks: list[str] = []
    current: list[str] = []

    def flush():
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    waiting: list = [(nodes[0], id(nodes[0]) in read)]  # with each part: is it inside?
    while waiting:
        part, inside = waiting.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(part if inside else "")
        elif not part.dropped and part.tag not in RAW and (inside or id(part) in way or id(part) in titles) and (id(part) in way or not _is_list_of_links(part, threshold)):
            inside = inside or id(part) in read or id(part) in titles
            if part.tag == "br":
                current.append(" ")
            if part.tag in BLOCKS:
                flush()
                waiting.append((None, inside))
            waiting.extend((p, inside) for p in reversed(part.parts))
    flush()
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row: the blocks of the main text in page order, joined by an empty line.

    White space in a block is one space. Null and empty pages, and pages without text, have text ''. Plain text without
    tags is its own main text. Repeated rows and null ids and urls give a row each; an empty table an empty result.
    """
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))

    def extract(batches):
        for batch, _, _ in slices(batches, "html"):
            found = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], ["page_id", "url", "text"])

    texts = narrow.mapInArrow(extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
