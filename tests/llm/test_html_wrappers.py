"""Main text of pages whose wrappers have class words, and of pages without article or main."""

import math
import re
from html.parser import HTMLParser

import pytest

from pagewright.llm import html_text
from pagewright.llm.html_text import main_text

TEXT = "A long text, with points. And more of it, here."


@pytest.mark.parametrize(
    "page",
    [
        '<html class="nav-open"><body class="has-sidebar"><article><p>{}</p></article></body></html>',
        '<body class="layout-no-sidebar"><div><p>{}</p></div></body>',
        '<body><div id="search-results"><article><p>{}</p></article></div></body>',
        '<body><main><div class="with-sidebar"><article><p>{}</p></article></div></main></body>',
        '<body><div class="no-sidebar"><div><p>{}</p></div></div></body>',
        '<body><form id="page"><main><p>{}</p></main></form></body>',
        '<body class="single right-sidebar"><article><p>{}</p></article></body>',
        '<html class="cookie-consent js"><body><article><p>{}</p></article></body></html>',
        '<div class="search results"><article><p>{}</p></article></div>',
        '<body><p title="a hidden gem">{}</p></body>',
        "<article><p class=don't>{}</p></article>",
        '<div><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{}</p></div><div><a href=3>Three</a></div></div>',
    ],
)
def test_wrappers(page):
    assert main_text(page.format(TEXT)) == TEXT


def test_boilerplate_stays_out():
    cards = '<div class="related"><article>Card one, here.</article><article>Card two, here.</article></div>'
    comments = '<div class="comments">' + "<article>So nice, this.</article>" * 20 + "</div>"
    assert main_text(f"<body class='has-sidebar'><main><article><p>{TEXT}</p></article>{cards}</main></body>") == TEXT
    assert main_text(f"<main><article><p>{TEXT * 3}</p>{comments}</article></main>") == TEXT * 3


@pytest.mark.parametrize("n", [1, 3, 5, 40])
def test_heading_and_lead_at_any_length(n):
    body = "".join(f"<p>{TEXT * 10}</p>" for _ in range(n))
    want = " ".join(["Title", "Lead, short.", *[TEXT * 10] * n, "A last section."])
    page = f"<body><div><a href=x>Home</a> <a href=y>Shop</a></div><div><h1>Title</h1><p>Lead, short.</p><div class=body>{body}</div><section>A last section.</section></div></body>"
    assert main_text(page) == want


class Paths(HTMLParser):
    """Blocks of well-formed pages of block elements and links: (path, characters, marks, linked characters)."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.link = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        else:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.stack.pop()

    def handle_data(self, data):
        if n := len(data.strip()):
            self.blocks.append(("/".join(self.stack), n, len(re.findall("[.,;:!?]", data)), n if self.link else 0))


SOUP = (
    "<body><div><ul><li><a>Home</a></li><li><a>Shop, all</a></li><li><a>About</a></li></ul></div><div><div><h1>A title</h1><p>Some text, here. And more.</p>"
    "<p>Again some text; it goes on and on, for a while.</p><p>So.</p></div></div><div><ul><li><a>Terms</a></li></ul></div></body>"
)


def test_path_scores_by_brute_force():
    paths = Paths()
    paths.feed(SOUP)
    fused, plain = {}, {}
    for path in {b[0] for b in paths.blocks}:
        mine = [b for b in paths.blocks if b[0] == path]
        chars, marks, linked = (sum(b[i] for b in mine) for i in (1, 2, 3))
        fused[path] = math.log2(1 + chars / len(mine)) * (1 + 5 * min(marks / chars, 0.2))
        plain[path] = 1 - 0.8 * linked / chars
    smooth = {}
    for i, b in enumerate(paths.blocks):
        near = [fused[x[0]] for x in paths.blocks[max(0, i - 1) : i + 2]]
        smooth.setdefault(b[0], []).append(sum(near) / len(near))
    root, blocks = html_text.parse(SOUP)
    got = html_text.path_scores(blocks)
    assert [pytest.approx(plain[p] * sum(smooth[p]) / len(smooth[p])) for p, *_ in paths.blocks] == [got[b.node.path] for b in blocks]
    assert main_text(SOUP) == "A title Some text, here. And more. Again some text; it goes on and on, for a while. So."


def test_scores_decide(monkeypatch):
    """With all paths alike, menus come through: nothing but the thresholds keeps them out."""
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: {b.node.path: 1.0 for b in blocks})
    assert "Home" in main_text(SOUP)


def test_deep_and_broken_markup():
    assert main_text("<div>" * 50_000 + "deep down" + "</div>" * 50_000) == "deep down"
    assert main_text("<p>one<p class='x>two") == "one" and main_text("<p>a <b>b</i> c</b> d</section> e") == "a b c d e"
    assert main_text("<p>x &lt; y<!-- no --!> --> z</p>") == "x < y z" and main_text("< p>1 < 2</p>") == "< p>1 < 2"
