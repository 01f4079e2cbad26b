"""Main text of HTML cells: paragraphs score their containers, the best container and its like siblings are kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, ROW, keyed

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object canvas".split())
NEVER = RAW | set("head nav footer aside form button select option dialog menu audio video map".split())
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption address details summary hgroup header nav footer aside form fieldset hr center"
    " dialog menu".split()
)
AROUND_P = BLOCK - {"p"}  # a paragraph holds no block, so an open one lies within the innermost other block
PARTS = set("tr thead tbody tfoot ul ol dl".split())  # no containers of their own: points go to what holds them
SCORED = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
WHOLE = {"html", "body", "main", "article"}  # never dropped for their names
ENDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
UNWANTED = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?"
    r"|sidebar\w*|side|footer|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe\w*|popup"
    r"|modal|overlay|comments?|commentlist|disqus|respond|repl(?:y|ies)|discussion|social|shar(?:e|ing)|related"
    r"|recommend\w*|widgets?|pagination|pager|toolbar|login|signup|search|skip|contentinfo|complementary|dialog)"
    r"(?:$|[-_ ])"
)
HEADER = re.compile(r"(?:^|[-_ ])header(?:$|[-_ ])")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
QUOTE = re.compile("[\"'>]")
DOWN = 0.25  # what points count within a container that only its name speaks against, but that holds most of the page's
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = 80  # characters, mostly no link text, from which a paragraph is running text
SENTENCE = re.compile(r"[.!?…。:]['\"”’)\]]*$")


class Node:
    __slots__ = (
        "tag", "parent", "inside", "items", "unwanted", "named", "factor", "chars", "linked", "commas", "links", "score",
    )

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False, named: bool = False):
        self.tag, self.parent, self.unwanted, self.named = tag, parent, unwanted, named
        self.factor = 1.0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.items: list[Node | str] = []
        self.chars = self.linked = self.commas = self.links = 0
        self.score = 0.0

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _tag_end(html: str, at: int, lost: set[int]) -> int:
    """Where the tag's ``>`` is, quotes heeded if they close; -1 without one.

    ``lost`` holds the quotes of the page from which no end was found, so that none is followed twice.
    """
    first = html.find(">", at)
    followed = []
    while first >= 0:
        found = QUOTE.search(html, at)
        if found and found[0] == ">":
            return found.start()
        closing = -1
        if found and found.start() not in lost:
            followed.append(found.start())
            closing = html.find(found[0], found.end())
        if closing < 0:
            lost.update(followed)
            return first
        at = closing + 1
    return first


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element goes for what it is, and whether its names speak against it."""
    if tag in WHOLE:
        return False, False
    if tag in NEVER or (tag == "header" and not inside):
        return True, False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true":
        return True, False
    if "display:none" in values.get("style", "").replace(" ", ""):
        return True, False
    names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
    return False, bool(UNWANTED.search(names)) or (not inside and bool(HEADER.search(names)))


def parsed(html: str) -> list[Node]:
    """Nodes of a page, parents before children. Tags that are never closed end where their surroundings do."""
    root = Node("html", None)
    nodes, stack = [root], [root]
    at, lost = 0, set()
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            stack[-1].items.append(html[at:])
            break
        if start > at:
            stack[-1].items.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        closing = html.startswith("</", start)
        name = NAME.match(html, start + 1 + closing)
        if not name:
            mark = html[start + 1 : start + 2]
            end = html.find(">", start) if mark and mark in "!?/" else -1
            if end < 0:
                stack[-1].items.append("<")
            at = end + 1 if end >= 0 else start + 1
            continue
        end = _tag_end(html, name.end(), lost)
        if end < 0:
            break
        tag, at = name[0].lower(), end + 1
        if closing:
            _close(stack, tag)
            continue
        attributes = html[name.end() : end]
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if not attributes.endswith("/"):
                at = over.end() if over else len(html)
            continue
        if tag in VOID:
            stack[-1].items.append(" ")
            if tag == "hr":
                _close(stack, "p")
            continue
        if tag in BLOCK:
            _close(stack, "p", AROUND_P)
        if tag in ENDS:
            _close(stack, tag, ENDS[tag])
        node = Node(tag, stack[-1], *_unwanted(tag, attributes, stack[-1].inside))
        stack[-1].items.append(node)
        nodes.append(node)
        stack.append(node)
    return nodes


def _close(stack: list[Node], tag: str, until: set[str] = frozenset()) -> None:
    """End the innermost open element of that name; an inline one not beyond its block, others not beyond ``until``."""
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag == tag:
            del stack[i:]
            return
        if open_tag in until or (tag not in BLOCK and open_tag in BLOCK):
            return


def _measure(nodes: list[Node]) -> None:
    """Characters, linked characters and commas of each node, unwanted parts left out."""
    for node in nodes:
        node.chars = node.linked = node.commas = node.links = 0
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                node.chars += len("".join(item.split()))
                node.commas += item.count(",") + item.count("，") + item.count("、")
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.parent and not node.unwanted:
            up = node.parent
            up.chars, up.linked = up.chars + node.chars, up.linked + node.linked
            up.commas, up.links = up.commas + node.commas, up.links + node.links


def _gone(nodes: list[Node]) -> set[int]:
    """Nodes that are unwanted, or within one that is."""
    gone: set[int] = set()
    for node in nodes:
        if node.unwanted or (node.parent is not None and id(node.parent) in gone):
            gone.add(id(node))
    return gone


def _points(nodes: list[Node], gone: set[int]) -> Iterator[tuple[Node, float]]:
    """Nodes with text of their own, and what each is worth."""
    for node in nodes:
        own = node.tag in SCORED or (node.tag in BLOCK and any(isinstance(i, str) and i.strip() for i in node.items))
        if own and node.chars and id(node) not in gone and node.parent:
            yield node, (1 + node.commas + min(node.chars / 100, 3)) * (1 - node.density)


def _free_forms(nodes: list[Node]) -> bool:
    """Take forms that are wrapped around the page's text for plain containers: whether there were any.

    Those that hold an article, or two paragraphs of running text or more and at least half of the page's.
    """
    if not any(n.tag == "form" for n in nodes):
        return False
    found, article = ({id(node): 0 for node in nodes} for _ in range(2))
    total = 0
    for node in reversed(nodes):
        if node.tag in ("p", "pre", "td", "li", "blockquote") and node.chars >= PARAGRAPH and node.density < 0.5:
            found[id(node)], total = 1, total + 1
        article[id(node)] |= node.tag in ("article", "main")
        if node.parent:
            found[id(node.parent)] += found[id(node)]
            article[id(node.parent)] |= article[id(node)]
    around = [n for n in nodes if n.tag == "form" and (article[id(n)] or found[id(n)] >= max(2, total / 2))]
    for node in around:
        node.unwanted = False
    return bool(around)


def _judge_names(nodes: list[Node]) -> None:
    """Drop the containers that their names speak against, but only score down those that hold most of the page.

    Points within others below a container that are dropped for their names do not count for it, nor for the page.
    """
    held, lost = ({id(node): 0.0 for node in nodes} for _ in range(2))
    for node, points in _points(nodes, _gone(nodes)):
        held[id(node)] += points
    total = sum(held.values())
    for node in reversed(nodes):
        own = id(node)
        if node.named and held[own] <= (total - lost[own]) / 2:
            node.unwanted = True
            held[own], lost[own] = 0.0, lost[own] + held[own]
        if node.parent:
            held[id(node.parent)] += held[own]
            lost[id(node.parent)] += lost[own]
    for node in nodes:
        node.factor = (node.parent.factor if node.parent else 1.0) * (DOWN if node.named else 1.0)


def _blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node in page order, without unwanted parts and menus.

    Parts scored down for their names are unwanted beside what is not. A list or table of links is a menu outside of
    an article element, unless a heading stands right before it.
    """
    held: list[str] = []
    last = ""
    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            held.append(item)
            continue
        ends = item is None or item.tag in BLOCK
        if ends and held:
            yield " ".join(unescape("".join(held)).split())
            held = []
        if item is None or item.unwanted or item.factor < node.factor:
            continue
        listed = item.tag in ("ul", "ol", "table", "div", "section") and item.links >= 3 and item.density > 0.6
        if listed and not item.inside and last not in HEADINGS:
            continue
        if item.tag in BLOCK and item.chars:
            last = item.tag
        if item.tag in BLOCK:
            todo.append(None)
        todo.extend(reversed(item.items))
    if held:
        yield " ".join(unescape("".join(held)).split())


def main_text(html: str) -> str:
    """Blocks of the article, joined by an empty line; '' if the page has no text."""
    nodes = parsed(html)
    _measure(nodes)
    if _free_forms(nodes):
        _measure(nodes)
    if not any(n.named for n in nodes):
        return _article(nodes)
    dropped = [n for n in nodes if n.named and not n.unwanted]
    _judge_names(nodes)
    _measure(nodes)
    text = _article(nodes)
    if not text:  # nothing is left, so names say nothing here
        for node in dropped:
            node.unwanted = False
        for node in nodes:
            node.factor, node.score = 1.0, 0.0
        _measure(nodes)
        text = _article(nodes)
    return text


def _article(nodes: list[Node]) -> str:
    gone = _gone(nodes)
    for node, points in _points(nodes, gone):
        points *= node.factor
        above = node.parent
        while above.tag in PARTS and above.parent:
            above = above.parent
        above.score += points
        if above.parent:
            above.parent.score += points / 2
    held = [n for n in nodes if n.score > 0 and id(n) not in gone]
    if not held:
        return "\n\n".join(b for b in _blocks(nodes[0]) if b)
    best = max(held, key=lambda n: n.score * (1 - n.density) * (1.5 if n.tag in ("article", "main") else 1))
    above = best
    while above.parent is not None:  # an article that holds the best container is the better container
        above = above.parent
        if above.tag in ("article", "main") and not above.unwanted:
            best = above
    if best.parent is None:
        return "\n\n".join(b for b in _blocks(best) if b)
    kept = [s for s in best.parent.items if isinstance(s, Node) and (s is best or _alike(s, best))]
    return "\n\n".join(b for s in kept for b in _blocks(s) if b)


def _alike(sibling: Node, best: Node) -> bool:
    """Whether a container's sibling belongs to the same text."""
    if sibling.unwanted or not sibling.chars or sibling.factor < best.factor:
        return False
    if sibling.tag == "p":
        if sibling.density < 0.25 and (sibling.chars > PARAGRAPH or sibling.links == 0):
            return True
        # A short sentence with a link in it is text, a row of links is not.
        return sibling.density < 0.75 and bool(SENTENCE.search(" ".join(_blocks(sibling))))
    return sibling.score >= max(10.0 * best.factor, 0.2 * best.score) and sibling.density < 0.25


def extracted(cell: Column) -> Column:
    """Main text of an HTML cell, '' for a missing or empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p or "") for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(cell)


def extracted_cells(rows: DataFrame, cell: str, row_index: str = ROW) -> DataFrame:
    """(row_key, row_index, text, n_chars) of every row: the article in its HTML cell.

    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go, by
    element, by name or, outside of article elements and not under a heading, by being lists of links. A form that is
    wrapped around the text of the page is no form. A container that only its name speaks against is scored down instead
    if it holds most of the page's points, and names do not count where they would leave no text. Paragraphs give their parent points for length and commas, less by
    the share of link text, and their grandparent half; the container with most points stays, with siblings of like
    points and bare paragraphs. Character references are decoded, white space in a block is one space, blocks stand in
    page order with an empty line between. Missing, empty and textless cells give ''. Whole pages are read however
    long; repeated rows each give a row, an empty table none. Other columns are not read. No shuffle.
    """
    found = keyed(rows, cell, row_index).withColumn("text", extracted(F.col(CELL))).drop(CELL)
    return found.withColumn("n_chars", F.length("text").cast("long"))
