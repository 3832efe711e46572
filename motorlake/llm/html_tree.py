"""A page as a tree of block elements, and simple tree matching of two such trees."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements without content, elements that hold no text of the page, inline
#: elements, and what ends an open paragraph or list item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var "
    "object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts "
    "mtable mtr mlabeledtr mtd mstyle mspace mpadded mphantom menclose semantics annotation annotation-xml".split()
)
#: Elements that make a layout; others come and go with the text.
STRUCTURE = frozenset("html body div section article main nav header footer aside form".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_UP_TO = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: Comments, empty svg elements, raw elements, tags (quotes may hold >), declarations; what stands
#: between is text.  A name ends at white space, / or >: <title-bar> is no title.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
#: Whole pairs, so that nothing inside a value or a longer name counts as a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    marks: str = ""
    hidden: bool = False
    #: Child nodes and runs of text in page order.
    items: list = field(default_factory=list)
    label: str = ""
    size: int = 1
    #: Does an article or main element stand below?
    holds_content: bool = False
    #: Hash of the labels from the root down, and of these with the node's own text.
    path: bytes = b""
    key: int = 0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def own(self) -> list[str]:
        return [x for x in self.items if isinstance(x, str)]

    def text(self) -> str:
        return "\n".join(t for t in (x if isinstance(x, str) else x.text() for x in self.items) if t)


def _marks(attrs: str) -> tuple[str, bool]:
    words, hidden = [], False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            words.append(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return " ".join(words), hidden


def parse(source: str) -> Node:
    """The tree of block elements; inline elements only pass their text on, and line breaks are spaces."""
    root = Node("#page")
    stack, run, at = [root], [], 0

    def finish() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            stack[-1].items.append(text)
        run.clear()

    for m in TOKEN.finditer(source):
        if m.start() > at:
            run.append(source[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
            continue
        if tag in ("img", "input", "source", "track", "embed", "param"):
            continue
        finish()
        if m.group("end"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES_UP_TO.get(tag, ()):
                break
            if stack[k].tag in CLOSES.get(tag, ()):
                del stack[k:]
                break
        if tag in VOID:
            continue
        node = Node(tag, *(_marks(m.group("attrs")) if m.group("attrs") else ("", False)))
        stack[-1].items.append(node)
        stack.append(node)
    if at < len(source):
        run.append(source[at:])
    finish()
    _label(root)
    return root


def _hash(before: bytes, text: str) -> bytes:
    return hashlib.blake2b(before + text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def shape(root: Node) -> int:
    """Pages of one layout have one shape: the paths of their structural elements, however often each stands."""
    found, todo = set(), [(root, b"")]
    while todo:
        node, path = todo.pop()
        if node.marks or node.tag in STRUCTURE:
            path = _hash(path, re.sub(r"[0-9]+", "0", node.label))
            found.add(path)
        todo.extend((c, path) for c in node.children())
    return int.from_bytes(_hash(b"".join(sorted(found)), ""), "big", signed=True)


def _label(root: Node) -> None:
    """Labels and sizes from the leaves up, without recursion (pages may nest deeply)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children())
    for node in reversed(order):
        node.label = f"{node.tag} {node.marks}"
        below = node.children()
        node.size = 1 + sum(c.size for c in below)
        node.holds_content = any(c.holds_content or c.tag in ("article", "main") for c in below)
    for node in order:  # parents come first
        node.path = _hash(node.path, node.label)
        if own := node.own():
            node.key = int.from_bytes(_hash(node.path, "\n".join(own)), "big", signed=True)
        for child in node.children():
            child.path = node.path


def match(a: Node, b: Node, limit: int = 200) -> list[tuple[Node, Node]]:
    """Pairs of nodes in a largest simple tree matching: equal labels, order and parents kept.

    Runs of leaves with equal labels at either end are paired directly, which is optimal for them;
    the rest of two lists of children goes through the usual table, weighing two children by the
    size of their own matching.  ``limit`` bounds the depth, not the width.
    """
    if a.label != b.label:
        return []
    pairs = [(a, b)]
    x, y = a.children(), b.children()
    if limit == 0 or not x or not y:
        return pairs
    lo = 0
    while lo < min(len(x), len(y)) and x[lo].label == y[lo].label and x[lo].size == y[lo].size == 1:
        pairs.append((x[lo], y[lo]))
        lo += 1
    x, y = x[lo:], y[lo:]
    tail = 0
    while tail < min(len(x), len(y)) and x[-1 - tail].label == y[-1 - tail].label and x[-1 - tail].size == y[-1 - tail].size == 1:
        pairs.append((x[-1 - tail], y[-1 - tail]))
        tail += 1
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not x or not y:
        return pairs
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    own: dict[tuple[int, int], list] = {}
    for i, u in enumerate(x, 1):
        row, above = best[i], best[i - 1]
        for j, v in enumerate(y, 1):
            top = max(above[j], row[j - 1])
            if u.label == v.label:
                inner = [(u, v)] if u.size == 1 or v.size == 1 else match(u, v, limit - 1)
                own[i, j] = inner
                top = max(top, above[j - 1] + len(inner))
            row[j] = top
    i, j = len(x), len(y)
    while i and j:
        if (i, j) in own and best[i][j] == best[i - 1][j - 1] + len(own[i, j]):
            pairs.extend(own[i, j])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs
