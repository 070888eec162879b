"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf path of block elements. For every path, text length,
punctuation and linked text are summed over its blocks; two ratios (characters a block, punctuation a character) are
fused into one, which is smoothed over neighbouring blocks in page order and weighed by the third, the share of text
outside of links. Names only weigh: a path in article or main counts MEANT_WEIGHT times, one in an element, class, id or role of the word lists JUNK_WEIGHT times
(the lists don't count on html, body and on what holds the page's main article or, without one, nearly all text). Paths
whose weighed score reaches CUT times the best, and FLOOR, are content.

The content root is the deepest element that holds nearly all of the content paths' text and, on pages without
article or main, has no unmarked prose beside it. Under it, blocks of other paths, such as headings and short list items,
belong to the text as well unless they are marked or, outside of article and main, mostly links.

Cases: null and empty html, and pages without text, give an empty text; broken, truncated and deeply nested markup is
read without recursion, attributes as browsers read them; a text is never cut; repeated rows and keys of any type stay;
an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import small_batches

# Elements of the HTML standard by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Not shown as text, or controls.
UNSEEN = frozenset("head script style noscript template iframe button select option textarea svg object canvas dialog title xmp noembed noframes".split())
BESIDE = frozenset("nav footer aside menu".split())
MEANT = frozenset("article main".split())
PAGE = frozenset("html body".split())
P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("table ul ol dl select article body html td th div section main nav footer aside form".split())
# Words in class, id or role that mark what isn't main text.
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup"
    r"|comments?|disqus|replies|respond|login|search|pagination|pager|widget|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
_OPENS = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
PUNCTUATION = re.compile(r"[.,;:!?，。！？；：、]")
MEANT_WEIGHT, JUNK_WEIGHT = 8.0, 0.005
CUT, FLOOR, SHARE, NEAR = 0.4, 0.15, 0.9, 1


@dataclass(eq=False)
class Node:
    """An open element. path numbers its chain of block elements, marked ones apart."""

    tag: str
    parent: Node | None
    hidden: bool = False
    meant: bool = False
    beside: bool = False
    worded: bool = False
    kids: list = field(default_factory=list)
    size: int = 0
    path: int = 0
    weight: float = 1.0
    mass: float = 0.0


@dataclass(eq=False)
class Block:
    """Text between two borders of block elements."""

    node: Node
    parts: list
    chars: int = 0
    points: int = 0
    linked: int = 0


def read_tag(source: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes from behind a tag's name and the place behind its end; None if the page ends first."""
    attrs: dict[str, str] = {}
    n = len(source)
    while True:
        at = _GAP.match(source, at).end()
        if at >= n:
            return None
        if source[at] == ">":
            return attrs, at + 1
        m = _NAME.match(source, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(source, at):
            at = m.end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                m = _BARE.match(source, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, value)


def _worded(tag: str, attrs: dict[str, str]) -> bool:
    """A form, or marked by a word of its class, id or role: page wrappers may be so as well."""
    if tag in MEANT or tag in PAGE:
        return False
    return tag == "form" or any(JUNK.search(attrs.get(a, "")) for a in ("class", "id", "role", "aria-label"))


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in UNSEEN or "hidden" in attrs or "aria-modal" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def parse(source: str) -> tuple[Node, list[Block]]:
    """The root and the blocks in page order."""
    root = node = Node("", None)
    blocks: list[Block] = []
    current: Block | None = None
    is_open: Counter = Counter()
    at, n = 0, len(source)

    def text(raw: str, plain: bool = True) -> None:
        nonlocal current
        if node.hidden:
            return
        if current is None:
            holder = node
            while holder.tag in INLINE:
                holder = holder.parent
            current = Block(holder, [])
            blocks.append(current)
        current.parts.append(raw)
        if plain and (size := len(raw.strip())):
            current.chars += size
            current.points += len(PUNCTUATION.findall(raw))
            up = node
            while up.tag in INLINE:
                if up.tag == "a":
                    current.linked += size
                    break
                up = up.parent
            node.size += size

    def leave(up: Node) -> None:
        """Close all up to and with this element."""
        nonlocal node
        while True:
            is_open[node.tag] -= 1
            node, gone = node.parent, node
            if gone is up:
                return

    while at < n:
        low = source.find("<", at)
        if low < 0:
            text(source[at:])
            break
        if low > at:
            text(source[at:low])
        m = _OPENS.match(source, low)
        if not m:
            if source.startswith("<!--", low):
                end = source.find("-->", low + 2)
                at = n if end < 0 else end + 3
            elif source[low + 1 : low + 2] in ("!", "?", "/") and low + 1 < n:
                end = source.find(">", low)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = low + 1
            continue
        found = read_tag(source, m.end())
        if found is None:  # cut off in the middle of a tag
            break
        attrs, at = found
        tag = m[1].lower()
        if source[low + 1] == "/":
            if tag not in INLINE:
                current = None
            if is_open[tag] > 0:
                up = node
                while up.tag != tag:
                    if tag in INLINE and up.tag in SCOPES:
                        break
                    up = up.parent
                if up.tag == tag:
                    leave(up)
            continue
        if tag == "br":
            text(" ", False)
            continue
        if tag not in INLINE:
            current = None
        if tag in VOID:
            continue
        if tag in P_CLOSERS and is_open["p"] > 0:
            up = node
            while up is not root and up.tag not in SCOPES:
                if up.tag == "p":
                    leave(up)
                    break
                up = up.parent
        if tag in SIBLINGS and any(is_open[c] > 0 for c in SIBLINGS[tag]):
            up, closes = node, SIBLINGS[tag]
            while up is not root:
                if up.tag in closes:
                    leave(up)
                    up = node
                elif up.tag in SCOPES:
                    break
                else:
                    up = up.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            if not end:
                break
            close = source.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        inside = Node(tag, node, node.hidden or _hidden(tag, attrs), node.meant or tag in MEANT or attrs.get("role", "").lower() == "main")
        inside.beside = tag in BESIDE or (tag == "header" and not node.meant)
        inside.worded = _worded(tag, attrs)
        node.kids.append(inside)
        is_open[tag] += 1
        node = inside
    _weigh(root)
    return root, [b for b in blocks if b.chars]


def _in_order(root: Node) -> list[Node]:
    """All elements, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.kids)
    return order


def _weigh(root: Node) -> None:
    """Number the paths and hand weights down. A word doesn't count on an element that holds the main article or, without one, nearly all text."""
    order = _in_order(root)
    for node in reversed(order):
        if node.parent is not None and not node.beside:
            node.parent.size += node.size
    # From the largest article or main inwards, while the next holds a good part of it: cards and comments don't.
    spared: set[Node] = set()
    at, meant = root, [n for n in order if n.tag in MEANT and not n.hidden and n.size]
    while meant:
        best = max(meant, key=lambda n: n.size)
        if at is not root and 4 * best.size < at.size:
            break
        up = best
        while up is not None and up not in spared:
            spared.add(up)
            up = up.parent
        below = {best}
        for node in order:
            if node.parent in below:
                below.add(node)
        at, meant = best, [n for n in meant if n is not best and n in below]
    paths: dict[tuple[int, str, bool], int] = {}
    for node in order:
        up = node.parent
        if up is None:
            continue
        wrapper = node in spared if spared else node.size >= SHARE * root.size
        marked = node.beside or (node.worded and not wrapper)
        node.weight = up.weight * (JUNK_WEIGHT if marked else 1.0)
        node.path = up.path if node.tag in INLINE and not marked else paths.setdefault((up.path, node.tag, marked), len(paths) + 1)


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused, smoothed and weighed score of each path."""
    chars, points, linked, count = Counter(), Counter(), Counter(), Counter()
    weight = {}
    for b in blocks:
        p = b.node.path
        chars[p] += b.chars
        points[p] += b.points
        linked[p] += b.linked
        count[p] += 1
        weight[p] = b.node.weight * (MEANT_WEIGHT if b.node.meant else 1.0)
    fused = {p: math.log2(1 + c / count[p]) * (1 + 5 * min(points[p] / c, 0.2)) for p, c in chars.items()}
    smooth: Counter = Counter()
    order = [fused[b.node.path] for b in blocks]
    for i, b in enumerate(blocks):
        near = order[max(0, i - NEAR) : i + NEAR + 1]
        smooth[b.node.path] += sum(near) / len(near)
    return {p: weight[p] * (1 - 0.8 * linked[p] / chars[p]) * smooth[p] / count[p] for p in chars}


def main_blocks(root: Node, blocks: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    score = path_scores(blocks)
    bound = max(FLOOR, CUT * max(score.values(), default=0.0))
    content = {p for p, v in score.items() if v >= bound}
    if not content:
        return []
    order = _in_order(root)
    plain, linked = Counter(), Counter()
    own = set()
    for b in blocks:
        if b.node.path in content:
            b.node.mass += b.chars * score[b.node.path]
        if b.node.weight >= 1:
            plain[b.node] += b.chars - b.linked
            linked[b.node] += b.linked
            if b.chars > 2 * b.linked:
                own.add(b.node)
    for node in reversed(order):
        if node.parent is not None:
            node.parent.mass += node.mass
            plain[node.parent] += plain[node]
            linked[node.parent] += linked[node]
    any_meant = any(b.node.meant and b.node.path in content for b in blocks)
    top = root
    while True:
        best = max(top.kids, key=lambda k: k.mass, default=None)
        if best is None or best.mass < SHARE * root.mass or best.tag in INLINE or best.tag == "p":
            break
        # Headings, leads and sections beside the best child belong to the text, whatever their share.
        if not any_meant and (top in own or any(k is not best and plain[k] > linked[k] for k in top.kids)):
            break
        top = best
        if top.tag in MEANT:
            break
    inside: dict[Node, bool] = {}
    for node in order:  # parents come first
        inside[node] = node is top or (node.parent is not None and inside[node.parent])
    lenient = lambda b: b.node.weight >= top.weight and (top.meant or b.chars > 2 * b.linked)
    return [b for b in blocks if inside[b.node] and (b.node.path in content or lenient(b))]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    cleaned = (" ".join(entities.unescape("".join(b.parts)).split()) for b in main_blocks(*parse(source)))
    return " ".join(b for b in cleaned if b)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every row."""

    def run(batches):
        for batch in batches:
            got = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["k", "u", "t", "n"])

    small_batches(pages.sparkSession)
    slim = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    return slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, u string, t string, n bigint").select(
        F.col("k").alias(key), F.col("u").alias(url), F.col("t").alias("text"), F.col("n").alias("n_chars")
    )


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
