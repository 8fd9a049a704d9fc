"""HTML to DOM leaf blocks: runs of text between block boundaries, with the element that holds them.

A tolerant scanner, linear in the length of the page: comments, declarations, scripts and styles go, unclosed and
misnested elements are closed where an ancestor closes, a cut-off tag at the end is dropped. Elements know their
parent only, so blocks share their ancestors.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that stay inside a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video select option textarea button title head".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that an opening tag of their group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that close an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[/!?a-zA-Z][^>]*\Z""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[\W_]+")


@dataclass(slots=True, eq=False)
class Node:
    name: str
    parent: Node | None
    #: The names in class, id and role, each as its words.
    marks: tuple[tuple[str, ...], ...] = ()
    depth: int = 0
    #: How many children of each name and marks there are.
    shapes: Counter = field(default_factory=Counter)
    #: What a reader of the tree keeps at an element.
    context: object = None


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link_chars: int


def _marks(attributes: str) -> tuple[tuple[str, ...], ...]:
    found: list[tuple[str, ...]] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "hidden":
            found.append(("hidden",))
        for token in (m[2] or m[3] or m[4] or "").split():
            words = tuple(w for w in _SPLIT.split(_HUMP.sub("-", token).lower()) if w)
            if words:
                found.append(words)
    return tuple(found)


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order; white space inside a block is one space, character references are decoded."""
    page = page or ""
    node = Node("", None)
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    links = hidden = silent = 0
    in_link = False
    at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, node, links))
            parts.clear()
        links = 0

    def text_of(raw: str) -> None:
        nonlocal links
        if raw and not hidden and not silent:
            parts.append(raw)
            if in_link:
                links += len(raw)

    def pop() -> None:
        nonlocal hidden, node
        hidden -= node.name in HIDDEN
        opened[node.name] -= 1
        node = node.parent

    while True:
        m = _TAG.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img"):
                text_of(" ")
            continue
        if name == "button":  # part of a form; stands inside a block without parting it
            silent = 0 if closing else 1
            continue
        if name in RAW:  # likewise
            if not closing:
                end = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        in_link, silent = False, 0
        if closing:
            if opened[name] > 0:
                while node.name != name:
                    pop()
                pop()
            continue
        if name in CLOSES_P and node.name == "p":
            pop()
        if name in VOID or attributes.endswith("/") and name in ("svg", "math"):
            continue
        if name in CLOSES:
            while node.name in CLOSES[name]:
                pop()
        marks = _marks(attributes) if attributes else ()
        node.shapes[name, marks] += 1
        node = Node(name, node, marks, node.depth + 1)
        opened[name] += 1
        hidden += name in HIDDEN
    flush()
    return out
