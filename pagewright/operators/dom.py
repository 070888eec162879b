"""A small document tree over the standard library's tokenizer, numbered by intervals.

Nodes are numbered in document order; node n holds exactly the nodes n.pre < k <= n.last, so that "inside" is a
comparison of numbers. Building and reading never recurse, whatever the depth of the markup."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pagewright.functions.arrow import mask_unended

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Which open elements a start tag ends, by the HTML standard's implied end tags.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Elements without visible product text.
NOISE = frozenset("script style noscript template svg iframe nav footer form select button".split())
HEAD_ONLY = frozenset("title meta link base script style".split())
BLOCKS = ENDS_P | frozenset("li dt dd td th tr tbody thead tfoot body html".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "pre", "last")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None, pre: int):
        self.tag, self.attrs, self.parent, self.pre, self.last = tag, attrs, parent, pre, pre
        self.kids: list[Node | str] = []

    def holds(self, other: Node) -> bool:
        return self.pre < other.pre <= self.last

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def label(self) -> str:
        return f"{self.get('class')} {self.get('id')}"


class Tree(HTMLParser):
    def __init__(self, source: str, unended: bool = True):
        """unended: character references without a semicolon are read, too, as the HTML standard does; otherwise they stay as written."""
        super().__init__(convert_charrefs=True)
        self._mask = None
        if not unended and (masked := mask_unended(source, mask := next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in source))) != source:
            source, self._mask = masked, mask
        self.root = Node("", {}, None, 0)
        self.nodes: list[Node] = []
        self._at = self.root
        self.feed(source)
        self.close()
        for node in reversed(self.nodes):  # children come after their parents
            if node.parent.last < node.last:
                node.parent.last = node.last

    def handle_starttag(self, tag, attrs):
        at = self._at
        if tag in ENDS_P:
            up = at
            while up.parent is not None and up.tag not in ("td", "th", "li", "table", "button", "body"):
                if up.tag == "p":
                    at = up.parent
                    break
                up = up.parent
        if tag in ENDS:
            ends, stops = ENDS[tag]
            up = at
            while up.parent is not None and up.tag not in stops:
                if up.tag in ends:
                    at = up.parent
                up = up.parent
        known: dict[str, str | None] = {}
        for k, v in attrs:
            known.setdefault(k, self._unmasked(v))
        node = Node(tag, known, at, len(self.nodes) + 1)
        at.kids.append(node)
        self.nodes.append(node)
        self._at = at if tag in VOID else node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        up = self._at
        while up.parent is not None:
            if up.tag == tag:
                self._at = up.parent
                return
            if up.tag in BLOCKS and tag not in BLOCKS:
                return
            up = up.parent

    def handle_data(self, data):
        self._at.kids.append(self._unmasked(data))

    def _unmasked(self, text: str | None) -> str | None:
        return text.replace(self._mask, "&") if self._mask and text else text

    # Selection, in document order.

    def select(self, *tags: str) -> list[Node]:
        return [n for n in self.nodes if n.tag in tags]

    def having(self, *names: str) -> list[Node]:
        return [n for n in self.nodes if any(x in n.attrs for x in names)]

    def labelled(self, *words: str) -> list[Node]:
        """Nodes whose class or id holds one of these words, whatever its case."""
        return [n for n in self.nodes if any(w in n.get(a).lower() for a in ("class", "id") for w in words)]

    def inside(self, outer: list[Node], tag: str) -> list[Node]:
        return [n for n in self.nodes if n.tag == tag and any(o.holds(n) for o in outer)]


def texts(node: Node, skip: frozenset[str] = frozenset()) -> list[str]:
    """Stripped text pieces below a node, in order; empty ones left out."""
    out, stack = [], [iter(node.kids)]
    while stack:
        for kid in stack[-1]:
            if isinstance(kid, str):
                if piece := kid.strip():
                    out.append(piece)
            elif kid.tag not in skip:
                stack.append(iter(kid.kids))
                break
        else:
            stack.pop()
    return out


def text_of(node: Node) -> str:
    return " ".join(texts(node))


_BLANK = re.compile("[ \t\r\f\v ]+")


def visible_text(tree: Tree) -> str:
    """Body text without page chrome, a line for each piece of text."""
    body = next((n for n in tree.nodes if n.tag == "body"), None) or tree.root
    hidden = NOISE if body.tag == "body" else NOISE | {"head", "title"}
    lines = (_BLANK.sub(" ", line).strip() for piece in texts(body, hidden) for line in piece.splitlines())
    return "\n".join(line for line in lines if line)
